"""Scalar expressions: qualities, number and time formats, coercions, regions, attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ATTRIBUTE = r'(\w+)\s+"(.+?)";'


def phred(p: Column) -> Column:
    """Quality -10 log10(1 - p), half-even rounding; 255 for p of 1 or more."""
    return F.when(p >= 1, 255).otherwise(F.bround(-10 * F.log10(1 - p)).cast("int"))


def eprob(q: Column) -> Column:
    """Probability of a quality: 1 - 10^(-q/10)."""
    return 1 - F.pow(F.lit(10.0), -q / 10)


def human_format(n: Column) -> Column:
    """One decimal and an SI suffix: 2356743467 is 2.4G."""
    x = n.cast("double")
    steps = [(1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "K")]
    out = F.format_string("%.1f%s", x, F.lit(""))
    for at, suffix in reversed(steps):
        out = F.when(F.abs(x) >= at, F.format_string("%.1f%s", x / at, F.lit(suffix))).otherwise(out)
    return out


def format_minutes(seconds: Column) -> Column:
    """Minutes and seconds: 125.5 is '2 minutes and 5 secs'."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d minutes and %d secs", F.floor(whole / 60).cast("long"), whole % 60)


def format_delta(seconds: Column) -> Column:
    """h:mm:ss."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def divide_by_logs(a: Column, b: Column) -> Column:
    """a / b as exp(ln a - ln b); null where either is not positive."""
    return F.when((a > 0) & (b > 0), F.exp(F.ln(a) - F.ln(b)))


def key_text(*parts: Column) -> Column:
    """A composite key as one text; its parts come back by key_parts whatever they hold."""
    return F.array_join(F.array(*[F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts]), "")


def key_parts(key: Column, n: int) -> list[Column]:
    """The n parts of a key_text."""
    out, rest = [], key
    for _ in range(n):
        size = F.substring_index(rest, ":", 1).cast("int")
        body = F.substring(rest, F.length(F.substring_index(rest, ":", 1)) + 2, F.length(rest))
        out.append(F.substring(body, F.lit(1), size))
        rest = F.substring(body, size + 1, F.length(body))
    return out


def coerced(s: Column) -> Column:
    """A struct (i, f, s): the text as integer, else as float, else as itself."""
    i = s.try_cast("long")
    f = F.when(i.isNull(), s.try_cast("double"))
    return F.struct(i.alias("i"), f.alias("f"), F.when(i.isNull() & f.isNull(), s).alias("s"))


# The palettes' colours (red, green, blue) by name, and greens from dark to light.
PALETTE = {
    "teal": (27, 158, 119), "vermilion": (217, 95, 2), "purple": (117, 112, 179), "magenta": (231, 41, 138),
    "green": (102, 166, 30), "yellow": (230, 171, 2), "brown": (166, 118, 29), "gray": (102, 102, 102),
}
GREENS = ((118, 197, 173), (164, 216, 201), (209, 236, 228), (232, 245, 241))


def named_colour(name: Column) -> Column:
    """A palette's colour as text; null for other names."""
    pairs = [x for k, rgb in PALETTE.items() for x in (F.lit(k), F.lit(",".join(map(str, rgb))))]
    return F.create_map(*pairs)[name]


def colour(r: Column, g: Column, b: Column) -> Column:
    return F.concat_ws(",", r.cast("string"), g.cast("string"), b.cast("string"))


def region(s: Column) -> Column:
    """A struct (chrom, start, end) of 'chr:a-b', a and b in order."""
    a, b = (F.regexp_replace(F.regexp_extract(s, r"^([^:]+):([\d,]+)-([\d,]+)$", i), ",", "").try_cast("long") for i in (2, 3))
    return F.struct(F.regexp_extract(s, r"^([^:]+):", 1).alias("chrom"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))


def in_region(chrom: Column, pos: Column, r: Column) -> Column:
    return (chrom == r["chrom"]) & pos.between(r["start"], r["end"])


def region_text(r: Column) -> Column:
    return F.format_string("%s:%d-%d", r["chrom"], r["start"], r["end"])


def attributes(s: Column) -> Column:
    """A map of the attributes k "v"; of an annotation row; of a key that repeats the last value counts."""
    keys = F.regexp_extract_all(s, F.lit(ATTRIBUTE), F.lit(1))
    values = F.regexp_extract_all(s, F.lit(ATTRIBUTE), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def attributes_text(m: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(' "'), e["value"], F.lit('";'))), " ")
