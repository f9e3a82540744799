"""Names, labels and parameters that are carried in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File-name forms, tried in this order, and the parameters that their groups give.
FORMS: tuple[tuple[str, tuple[str, ...]], ...] = (
    (r"M_(\d+)_.*efConstruction_(\d+).*_(\d+)\.\w+$", ("build", "ef_construction", "search")),
    (r"efConstruction_(\d+).*M_(\d+)_.*?_(\d+)\.\w+$", ("ef_construction", "build", "search")),
    (r"nlist_(\d+).*?_(\d+)\.\w+$", ("build", "search")),
    (r"_(\d+)_(\d+)\.\w+$", ("build", "search")),
)


def parameter(name: Column, which: str) -> Column:
    """A parameter from a file name: of the first form that fits; null if none has it."""
    tries = []
    for pattern, groups in FORMS:
        fits = name.rlike(pattern)
        value = F.regexp_extract(name, pattern, groups.index(which) + 1).cast("int") if which in groups else F.lit(None).cast("int")
        tries.append((fits, value))
    out = F.when(*tries[0])
    for t in tries[1:]:
        out = out.when(*t)
    return out


def path_level(path: Column, from_end: int) -> Column:
    """The directory so many levels above the end; null if there are fewer."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def sanitised(params: Column) -> Column:
    """Text with everything but letters, digits and _ run together to one _, none at the ends."""
    return F.trim(F.regexp_replace(params, r"\W+", "_"), F.lit("_"))


def query_name(number: Column, movies: Column) -> Column:
    """qm0007 or qr0007; more digits where four don't suffice."""
    return F.concat(F.when(movies, "qm").otherwise("qr"), F.format_string("%04d", number))


def query_number(name: Column) -> Column:
    return F.try_to_number(F.regexp_extract(name, r"^q[mr](\d+)$", 1), F.lit("999999999999")).cast("long")


def query_type(name: Column) -> Column:
    return F.when(name.startswith("qm"), "movies").when(name.startswith("qr"), "reviews")


def query_type_of_file(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("movies"), "movies").when(low.contains("reviews"), "reviews")


def index_type(algorithm: Column) -> Column:
    low = F.lower(algorithm)
    return F.when(low.contains("ivf"), "IVF").when(low.contains("hnsw"), "HNSW").otherwise("other")


def system(algorithm: Column, systems: list[str]) -> Column:
    """The first of the systems that the algorithm's name holds."""
    out = F.lit(None).cast("string")
    for s in reversed(systems):
        out = F.when(F.lower(algorithm).contains(s.lower()), s).otherwise(out)
    return out


def segment_size(tag: Column, default: int = 1024) -> Column:
    """Megabytes after -seg in an image's tag."""
    text = F.regexp_extract(F.coalesce(tag, F.lit("")), r"-seg(\d+)", 1)
    return F.when(text != "", text.cast("int")).otherwise(default)


def masked(text: Column) -> Column:
    """Text with its embeddings left out."""
    return F.regexp_replace(text, r"\[[-+0-9.eE, ]{3,}\]", "[...]")


def selectivity_label(s: Column) -> Column:
    """Two decimals from 0.01 on, else three."""
    return F.when(s >= 0.01, F.format_string("%.2f", s)).otherwise(F.format_string("%.3f", s))


def percent_label(s: Column) -> Column:
    return F.format_string("%.1f%%", s * 100)


def run_label(dataset: Column, count: Column, distance: Column) -> Column:
    return F.concat_ws("_", dataset, count.cast("string"), distance)


def run_label_parts(label: Column) -> Column:
    """(dataset, count, distance); the dataset may hold _ itself."""
    parts = F.split(label, "_")
    n = F.size(parts)
    return F.struct(F.array_join(F.slice(parts, 1, n - 2), "_").alias("dataset"), F.element_at(parts, n - 1).cast("int").alias("count"), F.element_at(parts, n).alias("distance"))


def flag(text: str | None, default: bool = False) -> bool:
    """Whether a setting says yes."""
    return default if text is None else text.strip().lower() in ("y", "yes", "1", "true", "t", "on")
