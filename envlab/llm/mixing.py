"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are counted once into cells (source x language x topic: tokens and documents). Raking
finds one factor per source, language and topic so that the weighted token shares of the cells meet
the three target marginals. Sources can be many, so they stay a distributed table: a cell row per
source holds its tokens by (language, topic), a source's factor is computed inside its row, and a
sweep returns to the driver one sum per (language, topic) only, whose number the target tables of
these two dimensions fix.

A document's weight is the product of its three factors. Times the expected tokens of the mix
(``budget`` times the tokens of the input) it is the expected number of the document's copies: it
comes in as many whole copies, and in one more by a seeded draw on its id with the rest as chance.
So the mix holds the budget and follows the targets in expectation, whatever the rarest cell is.

Without a budget the weight is divided by the largest weight of any cell: no document is repeated,
but that cell, however small, sets the scale of all others. So a mix of a corpus takes a budget.
"""
from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envlab.functions.draws import draw
from envlab.llm.common import column, store

SWEEPS = 8  # at least
TOLERANCE = 1e-6  # sweeps go on until every share is this close to its target
MAX_SWEEPS = 100  # or so many are done: the targets may contradict each other
BUDGET = 1.0  # expected tokens of the mix, per token of its input, in the query and the pipeline
SEED = 97
TOKEN = r"[^ \t\r\n]+"
# topics told by markers in the text, the first that fits
TOPICS: tuple[tuple[str, str], ...] = (("license", "icense"), ("contact", "@"), ("table", " | "))
OTHER_TOPIC = "prose"


@dataclass(frozen=True)
class Targets:
    """Target token shares. ``source_power`` tempers the sources (share ** power, normalised: 1
    keeps them, 0 makes them even); languages and topics have stated relative weights, and values
    that are not named get ``rest``. NULL values are values of their own."""

    language: dict[str, float]
    topic: dict[str, float]
    source_power: float = 0.7
    rest: float = 0.05


def topic_of(text: Column) -> Column:
    out = F.lit(OTHER_TOPIC)
    for name, mark in reversed(TOPICS):
        out = F.when(F.contains(text, F.lit(mark)), F.lit(name)).otherwise(out)
    return out


def described(docs: DataFrame) -> DataFrame:
    """``row`` (the document as a struct), ``source, lang, topic, tokens``: NULL source and lang
    become '', a NULL text has topic prose and no tokens."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.struct(*[column(c) for c in docs.columns]).alias("row"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"), topic_of(text).alias("topic"),
        F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("tokens"),
    )


@dataclass
class Rake:
    """Factors: ``sources`` (source, sf) as a table, languages and topics as dicts by value;
    ``top`` is the largest weight of a cell that holds tokens, ``total`` the tokens of all cells,
    ``gap`` the largest distance of a language or topic share from its target after the last sweep."""

    sources: DataFrame
    language: dict[str, float]
    topic: dict[str, float]
    top: float
    total: int
    gap: float


def rake(cells: DataFrame, targets: Targets, sweeps: int = SWEEPS) -> Rake:
    """Fit the factors on ``cells`` (source, lang, topic, tokens). A sweep sets the source factors,
    then the language factors, then the topic factors; a value without tokens keeps factor 0. After
    ``sweeps`` more follow while ``gap`` is above TOLERANCE, up to MAX_SWEEPS; a gap that stays above
    it is logged."""
    spark = cells.sparkSession
    # the distinct languages and topics: as many as the targets name, and one for the rest
    lang_key = _keyed(F.col("lang"), targets.language)
    topic_key = _keyed(F.col("topic"), targets.topic)
    langs, topics = [*targets.language, None], [*targets.topic, None]
    slots = {(a, b): i for i, (a, b) in enumerate((a, b) for a in langs for b in topics)}
    place = F.create_map(*[F.lit(x) for (a, b), i in slots.items() for x in (f"{_name(a)}|{_name(b)}", i)])
    at = F.element_at(place, F.concat(lang_key, F.lit("|"), topic_key))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    table = (
        cells.where("tokens > 0").withColumn("at", at).groupBy("source").agg(
            F.sum("tokens").alias("n"),
            F.array(*[F.coalesce(F.sum(F.when(F.col("at") == i, F.col("tokens"))), F.lit(0)).cast("double") for i in range(len(slots))]).alias("by"),
        ).withColumn("want", F.pow(F.col("n") / F.lit(float(max(total, 1))), F.lit(targets.source_power)))
    )
    table = store(table, "rake-sources")
    want_sum = table.agg(F.sum("want")).first()[0] or 1.0
    want_l, want_t = _shares(targets.language, targets.rest, langs), _shares(targets.topic, targets.rest, topics)
    fl, ft = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def with_factor() -> DataFrame:
        weight = [fl[a] * ft[b] for a, b in slots]
        mass = sum((F.col("by")[i] * F.lit(w) for i, w in enumerate(weight)), F.lit(0.0))
        return table.withColumn("sf", F.when(mass > 0, F.col("want") / F.lit(want_sum) / mass).otherwise(0.0))

    def gathered() -> dict:
        sums = with_factor().agg(*[F.sum(F.col("by")[i] * F.col("sf")).alias(f"m{i}") for i in range(len(slots))]).first()
        return {k: (sums[i] or 0.0) for k, i in slots.items()}

    def distance() -> float:
        gap = 0.0
        for f, want, pick in ((fl, want_l, 0), (ft, want_t, 1)):
            held = {v: sum(x * fl[k[0]] * ft[k[1]] for k, x in m.items() if k[pick] == v) for v in f}
            have = sum(want[v] for v in f if held[v] > 0) or 1.0
            gap = max([gap, *(abs(held[v] - want[v] / have) for v in f if held[v] > 0)])
        return gap

    done, m = 0, gathered()
    while done < sweeps or (done < MAX_SWEEPS and distance() > TOLERANCE):
        # values that hold no tokens take no share: the others' targets are scaled up
        for f, want, other, pick in ((fl, want_l, ft, 0), (ft, want_t, fl, 1)):
            held = {v: sum(x * other[k[1 - pick]] for k, x in m.items() if k[pick] == v) for v in f}
            have = sum(want[v] for v in f if held[v] > 0) or 1.0
            for v in f:
                f[v] = want[v] / have / held[v] if held[v] > 0 else 0.0
        done, m = done + 1, gathered()
    gap = distance()
    if gap > TOLERANCE:
        logging.getLogger(__name__).warning("shares are up to %.2g off their targets after %d sweeps", gap, done)
    last = with_factor()
    best = [F.when(F.col("by")[i] > 0, F.col("sf") * F.lit(fl[a] * ft[b])).otherwise(0.0) for (a, b), i in slots.items()]
    top = last.agg(F.max(F.greatest(*best))).first()[0] or 0.0
    return Rake(last.select("source", "sf"), {_name(k): v for k, v in fl.items()}, {_name(k): v for k, v in ft.items()}, top, total, gap)


def _name(value: str | None) -> str:
    return "\x00rest" if value is None else value


def _keyed(col: Column, named: dict[str, float]) -> Column:
    return F.when(col.isin(list(named)), col).otherwise(F.lit(_name(None)))


def _shares(named: dict[str, float], rest: float, values: list) -> dict:
    whole = sum(named.values()) + rest
    return {v: (rest if v is None else named[v]) / whole for v in values}


def _mixed(docs: DataFrame, targets: Targets, sweeps: int, seed: int, budget: float | None) -> DataFrame:
    """``described`` rows with ``weight, gap, chance, copies, kept``."""
    rows = described(docs)
    cells = store(rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), "mix-cells")
    r = rake(cells, targets, sweeps)
    factor = lambda col, named, f: F.element_at(
        F.create_map(*[F.lit(x) for k, v in f.items() for x in (k, v)]), _keyed(F.col(col), named)
    )
    weights = cells.where("tokens > 0").join(r.sources, "source").select(
        "source", "lang", "topic",
        (F.col("sf") * factor("lang", targets.language, r.language) * factor("topic", targets.topic, r.topic)).alias("weight"),
    )
    # one row per cell, stored so that the planner knows its size
    out = rows.join(store(weights, "mix-weights"), ["source", "lang", "topic"], "left").withColumn(
        "weight", F.coalesce("weight", F.lit(0.0)) * F.lit(float(r.total))
    )
    if budget is None:
        expected = F.col("weight") / F.lit(r.top * r.total) if r.top > 0 else F.lit(0.0)
    else:
        expected = F.col("weight") * F.lit(float(budget))
    name = F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null"))
    whole = F.floor("expected")
    more = draw(seed, "mix", name) < F.col("expected") - whole
    return (
        out.withColumn("gap", F.lit(r.gap)).withColumn("expected", expected).withColumn("copies", (whole + more.cast("int")).cast("long"))
        .withColumn("chance", F.least("expected", F.lit(1.0))).withColumn("kept", F.col("copies") > 0)
    )


def mix(docs: DataFrame, targets: Targets, sweeps: int = SWEEPS, seed: int = SEED, budget: float | None = None) -> DataFrame:
    """One row per document: ``doc_id, source, lang, topic, tokens, weight, chance, kept, copies, gap``.

    ``weight`` tells how much more a token counts than in the input (tokens times weight, summed by
    source, language or topic, gives the target shares of all tokens), ``chance`` that of being in the mix, ``copies`` how often it is (at most once
    without a ``budget``), ``gap`` the largest distance of a language or topic share from its target,
    the same in all rows. A document without tokens gets the weight of its cell if that holds other
    tokens and else 0; NULL source or lang are '' and belong to the rest unless named; rows with
    equal ids share their draw; an empty table gives no rows; other columns are ignored."""
    return _mixed(docs, targets, sweeps, seed, budget).select(
        F.col("row.doc_id").alias("doc_id"), "source", "lang", "topic", "tokens", "weight", "chance", "kept", "copies", "gap"
    )


def sample(docs: DataFrame, targets: Targets, sweeps: int = SWEEPS, seed: int = SEED, budget: float | None = None) -> DataFrame:
    """The kept rows of ``docs``, each as often as ``mix`` has copies of it, all columns as they are."""
    kept = _mixed(docs, targets, sweeps, seed, budget).where("kept")
    if budget is None:
        return kept.select("row.*")
    return kept.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
