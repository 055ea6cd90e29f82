"""The commands, from files to files."""

import numpy as np
import pytest

from arbora import cli
from arbora.sources import formats


@pytest.fixture
def here(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    a = np.zeros((60, 80, 3), dtype=np.uint8)
    a[10:30, 20:50] = (180, 90, 30)
    (tmp_path / "a.tif").write_bytes(formats.tiff_encode(a, formats.RasterMeta(80, 60, 3, 500000.0, 5300000.0, 1.0, -1.0, "EPSG:32633", None), "lzw"))
    rng = np.random.default_rng(4)
    (tmp_path / "a.las").write_bytes(formats.las_encode(np.column_stack([rng.uniform(0, 80, 3000), rng.uniform(0, 60, 3000), rng.uniform(0, 20, 3000)])))
    rows = ["TreeID;StemTag;Latin;Status;PX;PY;DBH", "1;s;Fagus sylvatica;alive;30,5;-20;300", "2;;Fagus sylvatica;Alive;70;-50;200", "3;;;dead;1;-1;100"]
    (tmp_path / "i.csv").write_text("\n".join(rows) + "\n")
    return tmp_path, a


def test_tiles_and_back(here):
    folder, a = here
    assert cli.main(["tiles", "a.tif", "--tile-width", "32", "--tile-height", "32", "--overlap", "8", "--output", "t"]) == 0
    assert cli.main(["join", "t", "--output", "back.png"]) == 0
    assert (formats.png_decode((folder / "back.png").read_bytes())[:, :, :3] == a).all()


def test_label_predict_validate(here, capsys):
    folder, _ = here
    assert cli.main(["weak", "a.tif", "--inventory-csv", "i.csv", "--tile-size", "64", "--overlap", "32", "--output", "w"]) == 0
    assert cli.main(["predict", "a.tif", "--weak-labels", "w/weak_labels.csv", "--tile-size", "64", "--overlap", "32", "--output", "p"]) == 0
    assert cli.main(["validate", "a.tif", "--inventory-csv", "i.csv", "--predictions-tiles", "p/masks/tiles", "--output", "v/t.csv"]) == 0
    assert cli.main(["validate", "a.tif", "--inventory-csv", "i.csv", "--predictions-npz", "p/masks/image_masks.npz", "--output", "v/m.csv"]) == 0
    said = capsys.readouterr().out
    assert said.count("total: 2") == 2 and said.count("match_rate: 100.0") == 2
    assert len((folder / "v" / "t.csv").read_text().splitlines()) == 3
    assert cli.main(["validate", "a.tif", "--inventory-csv", "i.csv", "--output", "x.csv"]) == 2
    assert cli.main(["weak", "a.tif", "--output", "x"]) == 2 and cli.main(["boxes", "a.tif", "--bbox", "20,10,50,30", "--tile-size", "64", "--overlap", "0", "--output", "b"]) == 0
    assert len(list((folder / "b" / "tiles_annotated").glob("*.png"))) == 2


def test_reports_and_pictures(here, capsys):
    folder, _ = here
    assert cli.main(["species", "i.csv", "--stem", "StemTag", "--output", "s.csv"]) == 0
    assert "European Beech" in capsys.readouterr().out and "66.67%" in (folder / "s.csv").read_text()
    assert cli.main(["heightmap", "a.las", "--width", "40", "--output", "h/h.png"]) == 0
    assert formats.png_decode((folder / "h" / "h.png").read_bytes()).shape[1] == 40
    assert cli.main(["heightmap", "a.las", "--width", "40", "--resolution", "1", "--output", "h/x.png"]) == 2
    assert cli.main(["overlay", "a.tif", "a.las", "--output", "o"]) == 0 and len(list((folder / "o").glob("*.png"))) == 1
    (folder / "src").mkdir()
    (folder / "src" / "m.py").write_text('"""M."""\n')
    assert cli.main(["docs", "src", "--output", "pages"]) == 0 and (folder / "pages" / "index.md").exists()
