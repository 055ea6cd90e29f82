"""Commands: weak, validate, predict, boxes, cached, tiles, join, heightmap, overlay, species, docs."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.columns import Crown, parse_bbox, parse_point
from .operators.inventory import ENGLISH_NAMES, summarise
from .plans import docs
from .plans import workflows as W
from .sources import formats, models, readers


def _inventory(p: argparse.ArgumentParser) -> None:
    p.add_argument("--inventory-csv")
    p.add_argument("--inventory-shp")
    for name, default in (("x-field", "PX"), ("y-field", "PY"), ("tree-id-field", "TreeID"), ("stem-id-field", "StemTag"), ("species-field", "Latin"), ("status-field", "Status"), ("status-filter", "alive"), ("dbh-field", "DBH"), ("dbh-unit", "mm")):
        p.add_argument(f"--{name}", default=default)
    p.add_argument("--min-dbh-cm", type=float, default=0.0)
    p.add_argument("--max-dbh-cm", type=float, default=0.0)
    p.add_argument("--deduplicate", action="store_true")


def _options(a: argparse.Namespace) -> W.InventoryOptions:
    return W.InventoryOptions(**{k: getattr(a, k) for k in W.InventoryOptions.__dataclass_fields__})


def _tiles(p: argparse.ArgumentParser, size: int, overlap: int) -> None:
    p.add_argument("--tile-size", type=int, default=size)
    p.add_argument("--overlap", type=int, default=overlap)


def parser() -> argparse.ArgumentParser:
    """The commands and their arguments."""
    top = argparse.ArgumentParser(prog="arbora")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("weak")
    p.add_argument("image")
    p.add_argument("--output", default="output/weak")
    _tiles(p, 1024, 128)
    p.add_argument("--crown-model", choices=("linear", "power"), default="linear")
    p.add_argument("--padding", type=float, default=4.0)
    p.add_argument("--pictures", action="store_true")
    _inventory(p)
    p = commands.add_parser("validate")
    p.add_argument("image")
    p.add_argument("--predictions-npz")
    p.add_argument("--predictions-tiles")
    p.add_argument("--output", default="output/validation/label_validation.csv")
    _inventory(p)
    p = commands.add_parser("predict")
    p.add_argument("image")
    p.add_argument("--output", default="output/predict")
    p.add_argument("--text")
    p.add_argument("--bbox", action="append", default=[], type=parse_bbox)
    p.add_argument("--point", action="append", default=[], type=parse_point)
    p.add_argument("--weak-labels")
    p.add_argument("--model", default="sam3")
    p.add_argument("--backend", help="module:attribute; without one every box is its own mask")
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--merge-iou", type=float, default=0.5)
    p.add_argument("--no-archive", action="store_true", help="no archive of the whole image")
    p.add_argument("--pictures", action="store_true")
    _tiles(p, 640, 64)
    p = commands.add_parser("boxes")
    p.add_argument("image")
    p.add_argument("--output", default="output/boxes")
    p.add_argument("--bbox", action="append", default=[], type=parse_bbox)
    p.add_argument("--weak-labels")
    p.add_argument("--backend")
    _tiles(p, 1024, 128)
    p = commands.add_parser("cached")
    p.add_argument("image")
    p.add_argument("--output", default="output/cached")
    p.add_argument("--text", default="tree crowns")
    p.add_argument("--backend", required=True)
    p.add_argument("--start", type=int, nargs=2, default=(0, 0), metavar=("X", "Y"), help="in tiles")
    p.add_argument("--max-tiles", type=int)
    p.add_argument("--no-cache", action="store_true")
    _tiles(p, 640, 64)
    p = commands.add_parser("tiles")
    p.add_argument("image")
    p.add_argument("--output", default="output/tiles")
    p.add_argument("--tile-width", type=int, default=2048)
    p.add_argument("--tile-height", type=int, default=2048)
    p.add_argument("--overlap", type=int, default=64)
    p = commands.add_parser("heightmap")
    p.add_argument("las")
    p.add_argument("--output", default="output/heightmap.png")
    p.add_argument("--method", choices=("max", "mean", "median"), default="max")
    for name, kind in (("resolution", float), ("width", int), ("height", int), ("low", float), ("high", float)):
        p.add_argument(f"--{name}", type=kind)
    p = commands.add_parser("overlay")
    p.add_argument("image")
    p.add_argument("las")
    p.add_argument("--output", default="output/overlay")
    p.add_argument("--method", choices=("max", "mean", "median"), default="max")
    p = commands.add_parser("join")
    p.add_argument("folder")
    p.add_argument("--output", default="output/joined.png")
    p = commands.add_parser("docs")
    p.add_argument("path")
    p.add_argument("--output", help="a folder for Markdown pages")
    p.add_argument("--findings", help="a linter's findings as JSON")
    p = commands.add_parser("species")
    p.add_argument("csv")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--output")
    for name, default in (("species", "Latin"), ("tree", "TreeID"), ("stem", "StemID")):
        p.add_argument(f"--{name}", default=default)
    return top


def main(argv: list[str] | None = None) -> int:
    """Run a command; 2 for wrong arguments."""
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("arbora").getOrCreate()
    try:
        _run(spark, a)
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    command = " ".join(sys.argv)
    for name in ("image", "las", "csv", "path", "folder", "inventory_csv", "inventory_shp", "weak_labels", "predictions_npz", "predictions_tiles", "output"):
        given = getattr(a, name, None)
        if given and "://" not in given:  # Spark's own processes may have been started elsewhere
            setattr(a, name, str(Path(given).resolve()))
            if name != "output" and not Path(given).exists():
                raise FileNotFoundError(f"there is no {given}")
    out = Path(getattr(a, "output", None) or ".")
    backend = W.BoxBackend() if not getattr(a, "backend", None) else models.backend_of(a.backend)
    by_tile = readers.weak_boxes(spark, a.weak_labels) if getattr(a, "weak_labels", None) else None
    if a.command == "weak":
        labels = W.make_weak_labels(spark, a.image, _options(a), a.inventory_csv, a.inventory_shp, a.tile_size, a.overlap, Crown(model=a.crown_model), a.padding)
        print(W.write_weak_labels(spark, labels, a.image, out, a.tile_size, a.overlap, a.pictures))
        W.write_run_metadata(out, a.image, a.tile_size, a.overlap, W.Prompts(), command=command)
    elif a.command == "validate":
        meta = readers.raster_meta(spark, a.image)
        trees = W.in_pixels(W.load_trees(spark, meta, _options(a), a.inventory_csv, a.inventory_shp), meta, Path(a.image).stem)
        if a.predictions_npz:  # wins where both are given
            runs, extents = readers.merged_masks(spark, a.predictions_npz), None
        elif a.predictions_tiles:
            runs, extents = readers.tile_masks(spark, a.predictions_tiles, meta.width, meta.height)
        else:
            raise ValueError("give predictions, merged or by tile")
        table, summary = W.validate(spark, trees, runs, extents, meta.width, meta.height)
        out.parent.mkdir(parents=True, exist_ok=True)
        W.write_csv(table, out)
        print("\n".join(f"{k}: {v}" for k, v in summary.first().asDict().items()))
    elif a.command == "predict":
        prompts = W.Prompts(a.text, a.bbox, a.point, by_tile)
        got = W.predict_masks(spark, a.image, prompts, backend, a.model, a.threshold, a.tile_size, a.overlap, a.merge_iou)
        out.mkdir(parents=True, exist_ok=True)
        print(W.write_predictions(spark, a.image, out, prompts, *got, archive=not a.no_archive, pictures=a.pictures))
        W.write_run_metadata(out, a.image, a.tile_size, a.overlap, prompts, a.model, command)
    elif a.command == "boxes":
        print(W.label_by_boxes(spark, a.image, a.bbox, out, backend, by_tile, a.tile_size, a.overlap))
    elif a.command == "cached":
        print(W.predict_cached(spark, a.image, out, backend, a.text, a.tile_size, a.overlap, tuple(a.start), a.max_tiles, not a.no_cache))
    elif a.command == "tiles":
        print(W.write_tiles(spark, a.image, a.output, a.tile_width, a.tile_height, a.overlap))
    elif a.command == "join":
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_bytes(formats.png_encode(W.reconstruct(spark, a.folder)))
    elif a.command == "heightmap":
        print(W.write_height_picture(spark, a.las, out, a.method, a.low, a.high, resolution=a.resolution, width=a.width, height=a.height))
    elif a.command == "overlay":
        print(W.write_height_overlay(spark, a.image, a.las, out, a.method))
    elif a.command == "docs":
        found = docs.definitions(spark, a.path)
        docs.coverage(found).orderBy("category").show()
        if a.findings:
            for table in docs.compliance(found, docs.findings(spark, a.findings)):
                table.show(1000, truncate=False)
        if a.output:
            print(docs.write_pages(found, out))
    else:
        table = summarise(readers.text_table(spark, a.csv), a.species, a.tree, a.stem, ENGLISH_NAMES, limit=a.limit)
        table = table.withColumn("share", F.format_string("%.2f%%", "share"))
        if a.output:
            W.write_csv(table, out)
        table.show(1000, truncate=False)


if __name__ == "__main__":
    sys.exit(main())
