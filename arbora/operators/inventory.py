"""Tree inventories: typed rows, filters, duplicates, and the summary by species."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .detections import ranked
from ..functions.columns import dbh_cm, first_present, parse_number, species_name, status_is, text_or_empty, title_case


#: English names of species.
ENGLISH_NAMES = {
    "Abies alba": "silver fir",
    "Acer campestre": "field maple",
    "Acer platanoides": "Norway maple",
    "Acer pseudoplatanus": "sycamore maple",
    "Aesculus hippocastanum": "horse chestnut",
    "Alnus glutinose": "black alder",
    "Betula": "birch",
    "Carpinus betulus": "European hornbeam",
    "Fagus sylvatica": "European beech",
    "Fraxinus excelsior": "European ash",
    "Juglans regia": "English walnut",
    "Larix decidua": "European larch",
    "Picea abies": "Norway spruce",
    "Pinus sylvestris": "Scots pine",
    "Populus": "poplar",
    "Populus tremula": "European aspen",
    "Prunus avium": "wild cherry",
    "Pseudotsuga menziesii": "Douglas fir",
    "Quercus": "oak",
    "Quercus rubra": "northern red oak",
    "Salix": "willow",
    "Sorbus aria": "whitebeam",
    "Sorbus aucuparia": "rowan",
    "Sorbus torminalis": "wild service tree",
    "Thuja plicata": "western red cedar",
    "Tilia": "lime",
    "Ulmus glabra": "wych elm",
    "Unidentified broadleaf": "unidentified broadleaf",
    "Unidentified conifer": "unidentified conifer",
    "(missing)": "(missing)",
}


def field(df: DataFrame, name: str, exact: bool = True) -> Column:
    """A column by name, or empty text if there is none; not exact: in any case."""
    for c in df.columns:
        if c == name or not exact and c.lower() == name.lower():
            return df[f"`{c}`"]
    return F.lit("")


def clean_csv(df: DataFrame, status_field: str, status_filter: str, x_field: str, y_field: str, dbh_field: str, unit: str = "cm", min_dbh: float = 0.0, max_dbh: float = 0.0, id_field: str = "TreeID", stem_field: str = "StemTag", species_field: str = "Latin") -> DataFrame:
    """Trees of a text table with its ordinal ord: status, numbers and diameters filtered; local metre offsets x, y.

    A missing column is empty. Rows whose x, y or diameter is no number, and
    rows with a diameter of 0 or less, go; max_dbh limits only above 0. NaN
    diameters stay, as no comparison holds for them.
    """
    rows = df.where(status_is(field(df, status_field), status_filter))
    dbh = parse_number(field(df, dbh_field))
    rows = rows.select("ord", text_or_empty(field(df, id_field)).alias("tree_id"), first_present(field(df, stem_field), field(df, "stemtag")).alias("stem_id"), F.nullif(text_or_empty(field(df, species_field)), F.lit("")).alias("species"), F.nullif(text_or_empty(field(df, status_field)), F.lit("")).alias("status"), parse_number(field(df, x_field)).alias("x"), parse_number(field(df, y_field)).alias("y"), dbh.alias("raw"))
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("raw").isNotNull() & (F.isnan("raw") | (F.col("raw") > 0)))
    return in_range(rows.withColumn("dbh_cm", dbh_cm(F.col("raw"), unit)).drop("raw"), min_dbh, max_dbh)


def in_range(trees: DataFrame, low: float, high: float) -> DataFrame:
    """Diameters in [low, high]; high counts only above 0; NaN stays."""
    d = F.col("dbh_cm")
    keep = F.isnan(d) | (d >= low)
    return trees.where(keep & (F.isnan(d) | (d <= high))) if high > 0 else trees.where(keep)


def clean_shapes(df: DataFrame, status_field: str, status_filter: str, dbh_field: str, unit: str = "cm", min_dbh: float = 0.0, max_dbh: float = 0.0, id_field: str = "TreeID", stem_field: str = "StemTag", species_field: str = "Latin") -> DataFrame:
    """Trees of a shape table with ord, x, y in longitude and latitude.

    A blank status counts as alive; names are sought in any case, with
    fallbacks; a tree without id is shp_{ord}; a diameter that is no number is
    -1, and only a diameter limit drops such trees.
    """
    at = lambda *names: first_present(*[field(df, n, exact=False) for n in names])
    status = at(status_field, "status")
    rows = df.where(status_is(status, status_filter, blank_as="alive") & F.col("x").isNotNull() & F.col("y").isNotNull())
    raw = parse_number(at(dbh_field, "dbh"))
    rows = rows.select("ord", F.coalesce(at(id_field, "treeid", "tag", "stemtag"), F.concat(F.lit("shp_"), F.col("ord").cast("string"))).alias("tree_id"), at(stem_field, "stemtag").alias("stem_id"), at(species_field, "species", "latin").alias("species"), F.coalesce(status, F.lit("alive")).alias("status"), "x", "y", F.when(raw > 0, dbh_cm(raw, unit)).otherwise(-1.0).alias("dbh_cm"))
    if min_dbh > 0 or max_dbh > 0:
        rows = in_range(rows.where("dbh_cm > 0"), min_dbh, max_dbh)
    return rows


def deduplicate(trees: DataFrame, key: str = "tree_id", size: str = "dbh_cm", order: Sequence[str] = ("ord",)) -> DataFrame:
    """Of each id the row of greatest size, the first of equals; sizes of 0 or less are equal; rows with a blank id all stay.

    Blank ids take no part in the window, so they form no group.
    """
    blank = text_or_empty(F.col(key)) == ""
    rank = F.when(F.col(size) > 0, F.col(size)).otherwise(F.lit(-1.0))
    best = F.row_number().over(W.partitionBy(key).orderBy(rank.desc(), *order))
    return trees.where(~blank).withColumn("_r", best).where("_r = 1").drop("_r").unionByName(trees.where(blank))


def in_id_order(trees: DataFrame, *places: str) -> DataFrame:
    """Trees whose ord is their rank by id, then by places, then as before: what later ties go by after duplicates have gone."""
    return ranked(trees, F.asc("tree_id"), *[F.asc(p) for p in places], F.asc("ord")).drop("ord").withColumnRenamed("rank", "ord")


def summarise(df: DataFrame, species: str, tree: str, stem: str, english: Mapping[str, str] | None = None, limit: int = 0) -> DataFrame:
    """Per species: records, distinct trees and stems (blanks don't count), share of all records in percent, English name.

    Most records first, then by name; a limit cuts the list after the shares.
    """
    present = lambda c: F.nullif(text_or_empty(F.col(c)), F.lit(""))
    rows = df.select(species_name(F.col(species)).alias("latin_name"), present(tree).alias("t"), present(stem).alias("s"))
    out = rows.groupBy("latin_name").agg(F.count("*").alias("records"), F.countDistinct("t").alias("unique_trees"), F.countDistinct("s").alias("unique_stems"))
    out = out.withColumn("share", F.col("records") * 100.0 / F.sum("records").over(W.partitionBy()))
    name = F.col("latin_name")
    if english:
        pairs = F.create_map(*[F.lit(x) for kv in english.items() for x in kv])
        name = F.coalesce(F.try_element_at(pairs, F.col("latin_name")), F.col("latin_name"))
    out = out.withColumn("english_name", title_case(name)).orderBy(F.desc("records"), "latin_name")
    return out.limit(limit) if limit else out


def stem_or_tree(stem: Column, tree: Column) -> Column:
    """A stem's id, or its tree's."""
    return F.coalesce(F.nullif(text_or_empty(stem), F.lit("")), tree)
