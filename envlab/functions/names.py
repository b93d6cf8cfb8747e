"""Run-name and path parsing / formatting (F7-F12, F14), as built-in regex expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference (regular expressions, in Java syntax; the look-ahead is kept).
RE_ALGO = r"^eval[\-_ ]([a-z0-9]+)"
RE_LR = r"lr[\-_ ]([0-9eE.\+\-]+)(?=[\-_ ]seed)"
RE_LR_AFTER_ALGO = r"^eval[\-_ ][a-z0-9]+[\-_ ]([0-9eE.\+\-]+)(?=[\-_ ]seed)"
RE_SEED = r"seed_?(\d+)"
RE_MODEL = r"model[\-_ ]([\d _]+)"
RE_LR_PATH = r"(?i)lr([0-9]*\.?[0-9]+(?:e-?\d+)?)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _extract(s: Column, pattern: str) -> Column:
    """First match's group 1, NULL when there is no match (every group here is non-empty)."""
    return F.nullif(F.regexp_extract(s, pattern, 1), F.lit(""))


def digits_to_int(s: Column) -> Column:
    """F8: drop every non-digit, then integer; NULL when nothing is left."""
    d = F.regexp_replace(s, r"[^0-9]", "")
    return F.when(d != "", d.try_cast("long"))


def parse_run_name(name) -> Column:
    """struct(algo, lr, seed, model) from names like ``eval-erm-lr_5e-5-seed_3-model-25000``.

    ``lr`` stays a string (it is a label; :func:`lr_number` gives its value). Missing parts are NULL.
    """
    s = F.lower(F.trim(F.coalesce(_c(name), F.lit(""))))
    lr = F.coalesce(_extract(s, RE_LR), _extract(s, RE_LR_AFTER_ALGO))
    model = _extract(s, RE_MODEL)
    return F.struct(
        _extract(s, RE_ALGO).alias("algo"),
        lr.alias("lr"),
        _extract(s, RE_SEED).try_cast("int").alias("seed"),
        digits_to_int(model).alias("model"),
    )


def lr_number(lr) -> Column:
    """numeric learning rate of a string label (spaces removed); NULL when not a number."""
    return F.regexp_replace(_c(lr).cast("string"), " ", "").try_cast("double")


def lr_from_path(path) -> Column:
    """first ``lr<number>`` in a path (case-insensitive), as a double; NULL when absent."""
    p = _c(path)
    return _extract(p, RE_LR_PATH).try_cast("double")


def gap_suffix(gap) -> Column:
    """``gap * 100`` zero-padded to three digits (rounded: the reference truncates, so 0.29 gave 028)."""
    return F.format_string("%03d", F.round(_c(gap) * 100).cast("int"))


def grid_run_name(algo, gap, lr: Column, seed, steps, k=None, freeze=None) -> Column:
    """``{algo}_gap{ggg}_lr{lr}_seed{s}_steps{n}[_K{k}][_freeze{0|1}]``; ``lr`` is a string label."""
    parts = [
        _c(algo),
        F.concat(F.lit("gap"), gap_suffix(gap)),
        F.concat(F.lit("lr"), _c(lr)),
        F.concat(F.lit("seed"), _c(seed).cast("string")),
        F.concat(F.lit("steps"), _c(steps).cast("string")),
    ]
    if k is not None:
        parts.append(F.concat(F.lit("K"), _c(k).cast("string")))
    if freeze is not None:
        parts.append(F.concat(F.lit("freeze"), _c(freeze).cast("int").cast("string")))
    return F.concat_ws("_", *parts)


def run_tags(name) -> Column:
    """struct(algo = first ``_`` token, group = first token starting with ``gap`` else ``gapNA``,
    k and freeze = first token starting so, NULL without one)."""
    toks = F.split(_c(name), "_")
    gap = F.filter(toks, lambda t: t.startswith("gap"))
    return F.struct(
        F.try_element_at(toks, F.lit(1)).alias("algo"),
        F.coalesce(F.try_element_at(gap, F.lit(1)), F.lit("gapNA")).alias("group"),
        F.try_element_at(F.filter(toks, lambda t: t.rlike("^K[0-9]+$")), F.lit(1)).alias("k"),
        F.try_element_at(F.filter(toks, lambda t: t.startswith("freeze")), F.lit(1)).alias("freeze"),
    )
