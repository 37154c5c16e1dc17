"""Quality rules with risk-controlled thresholds.

Every text gets counts; every rule is a score, in which larger is worse. The parameters name a sequence of steps, fixed beforehand, each of
which tightens the cutoff of one rule. After each step the false rejections are the labelled good documents of a stratum (language) that the base rules let pass
and any rule rejects at the cutoffs so far, and an exact (Clopper-Pearson) upper bound of their rate is held against ``risk``. A stratum goes down the sequence until
a bound is over the risk and takes the cutoffs of the step before: tests in a fixed sequence that ends with the first failure need no
correction among themselves, and each stratum's sequence gets delta / number of strata (Bonferroni). So with probability 1 - delta, in no stratum do the rules
reject more than ``risk`` of the good documents that the base rules let pass, as far as the labelled ones are a sample of them. The base rules are given and have
no cutoff to choose; ``bounds`` reports for each stratum how many good documents they reject, and the exact bound of the whole loss, theirs included.

Every language whose good labels are enough for a first step is a stratum. All other labelled languages together are one more, tested on their own
labels only: the bound holds for them as a whole and not for each. Where their labels are too few too, and for languages without any label of a
good document, no rule rejects.

The histogram that the bounds are computed from has one row per labelled language and a column per step, however many documents there are. No language is left out of it. It goes through the
driver part by part: what stays there are the rows of languages that may have enough labels, of which there are few for the number of labels, the names of the others, and their sum. Texts without words score 0 in every rule. Null texts are as texts without words; null is a language like others; repeated rows count each; labels of other documents or without a quality are ignored; without labels no rule rejects.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, compact, drop_since, map_arrow, shared_table, tables_so_far, utf8_values

SYMBOLS = b"#*$%&|<>"
GRAM = 8
NONE = "*"  # stands for a null language


@dataclass(frozen=True)
class Rules:
    """Parameters. ``most``: if given, only so many languages get cutoffs, those of ``strata`` first, then those with most labels; others are judged by the base rules alone. ``scores``: of each rule the count that it is about and the count that this is
    divided by; ``steps``: which rule gets which cutoff next."""

    strata: tuple[str, ...] = ("en", "fr", "de", "es")
    scores: tuple[tuple[str, str, str], ...] = (
        ("symbols_per_word", "n_symbols", "n_words"),
        ("marks_per_word", "n_marks", "n_words"),
        ("repeat_share", "n_repeat_words", "n_words"),
        ("stutter_share", "n_stutters", "n_words"),
        ("dup_line_share", "n_dup_lines", "n_lines"),
        ("word_length", "word_chars", "n_words"),
    )
    steps: tuple[tuple[str, float], ...] = (
        *(("symbols_per_word", c) for c in (2.0, 1.0, 0.5, 0.2, 0.1)),
        *(("marks_per_word", c) for c in (2.0, 1.0, 0.5, 0.2)),
        *(("repeat_share", c) for c in (0.8, 0.5, 0.3)),
        *(("stutter_share", c) for c in (0.8, 0.5, 0.3, 0.2)),
        *(("dup_line_share", c) for c in (0.9, 0.7, 0.5, 0.4)),
        *(("word_length", c) for c in (20.0, 15.0, 12.0, 10.0)),
        ("stutter_share", 0.1),
        ("symbols_per_word", 0.05),
        ("marks_per_word", 0.1),
        ("repeat_share", 0.25),
    )
    risk: float = 0.02
    delta: float = 0.05
    most: int | None = None

    def levels(self) -> list[dict[str, float]]:
        """Cutoffs after each step."""
        out: list[dict[str, float]] = []
        for name, cut in self.steps:
            out.append((out[-1] if out else {}) | {name: cut})
        return out


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, n_stutters long"


def _mix(n: int) -> np.ndarray:
    """Fixed pseudo-random 64-bit numbers, one for each word id."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(ids: np.ndarray, n_distinct: int, gram: int = GRAM) -> int:
    """Words in windows of ``gram`` words that occur twice or more. Windows are compared by 64-bit hashes."""
    n = len(ids) - gram + 1
    if n < 2 or n_distinct == len(ids):
        return 0
    word, h = _mix(n_distinct)[ids], np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(gram):
            h = (h * np.uint64(0xD6E8FEB86659FD93)) + word[i : i + n]
            h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + gram, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """What COUNTS names but word_chars: for the code points see count_batch."""
    words = text.split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    rep = repeated_words(ids, len(seen)) if len(words) > GRAM else 0
    return len(words), n_symbols, len(lines) - len(set(lines)), rep, len(lines), text.count(b"!"), int((ids[1:] == ids[:-1]).sum())


def count_batch(texts: pa.Array) -> list[pa.Array]:
    """Columns of COUNTS, in that order."""
    raw = [t or b"" for t in utf8_values(texts)]
    points = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    space = np.array([len(t) - len(t.translate(None, SPACE)) for t in raw], np.int64)
    rows = np.array([text_counts(t) for t in raw], np.int64).reshape(-1, 7)
    cols = [rows[:, 0], points - space, *(rows[:, i] for i in range(1, 7))]
    return [pa.array(c) for c in cols]


def with_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, language and COUNTS of every row; whole texts, one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *count_batch(b.column(2))], names=[id_col, lang_col, *(c.split()[0] for c in COUNTS.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col).cast("string").alias(lang_col) if lang_col in docs.columns else F.lit(None).cast("string").alias(lang_col)
    return map_arrow(docs.select(id_col, lang, F.col(text_col).cast("string")), run, f"{id_col} {kind}, {lang_col} string, {COUNTS}")


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def scores(rules: Rules) -> list[tuple[str, Column]]:
    return [(name, F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(F.col(count) / F.col(by))) for name, count, by in rules.scores]


def language(lang_col: str = "lang") -> Column:
    return F.coalesce(F.col(lang_col), F.lit(NONE))


def binomial_upper(k: int, n: int, delta: float) -> float:
    """The exact upper confidence bound of a binomial proportion: the p at which P(X <= k) = delta."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def cdf(p: float) -> float:
        a, b = math.log(p), math.log1p(-p)
        terms = [c + i * a + (n - i) * b for i, c in enumerate(logs)]
        top = max(terms)
        return top + math.log(sum(math.exp(t - top) for t in terms))

    lo, hi, want = k / n, 1.0, math.log(delta)
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid in (0.0, 1.0) or cdf(mid) <= want:
            hi = mid
        else:
            lo = mid
    return hi


def exceeds(k: int, n: int, limit: float, delta: float) -> bool:
    """Whether the upper bound for k of n is over ``limit``; cheap where k alone tells."""
    return n == 0 or k >= n * limit or binomial_upper(k, n, delta) > limit


def enough(rules: Rules) -> int | None:
    """The fewest labelled documents with which a language can be a stratum of its own, were it the only one; None where no number is enough."""
    wanting = lambda n: exceeds(0, n, rules.risk, rules.delta / 2)
    hi = 1
    while wanting(hi):
        hi *= 2
        if hi > 1 << 40:
            return None
    lo = hi // 2
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if wanting(mid) else (lo, mid)
    return hi


@dataclass(frozen=True)
class Stratum:
    """Languages that are judged alike. ``good``: labelled good documents; ``passed``: of these, what the base rules let pass; ``over``: of these, what is rejected
    after each step; ``step``: the last one that is taken, -1 for none; ``delta``: probability that its bound may fail."""

    names: tuple[str, ...]
    good: int
    passed: int
    over: tuple[int, ...]
    step: int
    delta: float


def strata(counts: DataFrame, labels: DataFrame, rules: Rules = Rules(), *, id_col: str = "doc_id", lang_col: str = "lang") -> list[Stratum]:
    """The strata with their steps; the last is the one of languages with few labels. ``counts`` is joined with the labels by id; the histogram goes through the driver."""
    good, levels = labels.where("quality = 1").select(F.col("doc_id").alias(id_col)), rules.levels()
    held = counts.join(good, id_col, "left_semi").select(language(lang_col).alias("stratum"), (~base_failed()).alias("passes"), *(s.alias(n) for n, s in scores(rules)))
    count = lambda c: F.sum(c.cast("long"))
    over = [count(F.col("passes") & functools.reduce(operator.or_, (F.col(n) > c for n, c in level.items()))).alias(str(i)) for i, level in enumerate(levels)]
    seen = held.groupBy("stratum").agg(F.count("*").alias("good"), count(F.col("passes")).alias("passed"), *over)
    if rules.most is not None:
        seen = seen.orderBy(F.col("stratum").isin(*rules.strata).desc(), F.desc("passed"), "stratum").limit(rules.most)
    least, rows, names, few = enough(rules), [], [], dict.fromkeys(("good", "passed", *map(str, range(len(levels)))), 0)
    for r in compact(seen).toLocalIterator():
        if least is not None and r["passed"] >= least:
            rows.append(r.asDict())
        else:
            names.append((-r["passed"], r["stratum"]))
            few = {k: n + r[k] for k, n in few.items()}
    rows = sorted(rows, key=lambda r: (-r["passed"], r["stratum"]))
    # as many strata as have enough labels at a delta that all of them and the rest share; which these are depends on the numbers of labels only
    own = max((i for i, r in enumerate(rows, 1) if not exceeds(0, r["passed"], rules.risk, rules.delta / (i + 1))), default=0)
    rest = {k: n + sum(r[k] for r in rows[own:]) for k, n in few.items()}
    groups = [((r["stratum"],), r) for r in rows[:own]] + [((*(r["stratum"] for r in rows[own:]), *(n for _, n in sorted(names))), rest)]
    delta, out = rules.delta / (own + 1), []
    for group, r in groups:
        passed, lost = r["passed"], tuple(r[str(i)] for i in range(len(levels)))
        step = -1
        while step + 1 < len(levels) and not exceeds(lost[step + 1], passed, rules.risk, delta):
            step += 1
        out.append(Stratum(group, r["good"], passed, lost, step, delta))
    return out


def fit(counts: DataFrame, labels: DataFrame, rules: Rules = Rules(), *, id_col: str = "doc_id", lang_col: str = "lang") -> dict[str, dict[str, float]]:
    """Cutoffs by language and rule; languages that aren't named have none."""
    found, levels = strata(counts, labels, rules, id_col=id_col, lang_col=lang_col), rules.levels()
    return {s: {} for s in (NONE, *rules.strata)} | {name: levels[s.step] if s.step >= 0 else {} for s in found for name in s.names}


def bounds(counts: DataFrame, labels: DataFrame, rules: Rules = Rules(), *, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """A row for each stratum: its languages, good documents, those that the base rules and that the chosen cutoffs reject, and the exact upper bounds of the cutoffs' rate
    among what passes the base rules, and of the whole loss, each at the stratum's delta."""
    rows = []
    for s in strata(counts, labels, rules, id_col=id_col, lang_col=lang_col):
        base, own = s.good - s.passed, s.over[s.step] if s.step >= 0 else 0
        rows.append((",".join(s.names), s.good, base, own, s.step, binomial_upper(own, s.passed, s.delta) if s.step >= 0 else 0.0, binomial_upper(base + own, s.good, s.delta), s.delta))
    return counts.sparkSession.createDataFrame(rows, "languages string, good long, base_rejected long, rules_rejected long, step int, rules_bound double, loss_bound double, delta double")


def alike(cutoffs: dict[str, dict[str, float]]) -> list[tuple[list[str], dict[str, float]]]:
    """Languages with the same cutoffs, and these; without those that have none."""
    out: dict[tuple, list[str]] = {}
    for s, cuts in cutoffs.items():
        out.setdefault(tuple(cuts.items()), []).append(s)
    return [(names, dict(cuts)) for cuts, names in out.items() if cuts]


def verdict(rules: Rules, cutoffs: dict[str, dict[str, float]], lang_col: str = "lang") -> Column:
    """Kept: not base_failed and no score over its language's cutoff. The expression's size is that of the rules and strata."""
    bad = F.lit(False)
    for names, cuts in alike(cutoffs):
        own = F.lit(False)
        for name, score in scores(rules):
            if name in cuts:
                own = own | (score > cuts[name])
        bad = bad | (language(lang_col).isin(*names) & own)
    return ~base_failed() & ~bad


def quality_verdicts(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, counts, base_failed and kept. Counts are written once to the shared folder, then fitted on and judged."""
    counts = shared_table(with_counts(docs), "quality-counts")
    kept = verdict(rules, fit(counts, labels, rules))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their columns. Texts are counted again where they are judged, rather than shuffled."""
    since = tables_so_far()
    labelled = shared_table(with_counts(docs).join(labels.select("doc_id"), "doc_id", "left_semi"), "quality-labelled")
    cutoffs = fit(labelled, labels, rules)
    drop_since(docs.sparkSession, since)
    names = docs.columns
    keep = _row_judge(rules, alike(cutoffs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = keep(b.column(names.index("lang")) if "lang" in names else pa.nulls(len(b), pa.string()), count_batch(b.column(names.index("text"))))
            yield b.filter(pa.array(mask))

    return map_arrow(docs, run, docs.schema)


def _row_judge(rules: Rules, by: list[tuple[list[str], dict[str, float]]]):
    """The same verdict as ``verdict`` on Arrow columns; test_quality holds the two against each other."""
    names = [c.split()[0] for c in COUNTS.split(", ")]
    groups = [(frozenset(same), cuts) for same, cuts in by]

    def keep(lang: pa.Array, cols: list[pa.Array]) -> np.ndarray:
        x = {n: c.to_numpy(zero_copy_only=False).astype(np.float64) for n, c in zip(names, cols, strict=True)}
        langs = [NONE if v is None else v for v in lang.to_pylist()]
        with np.errstate(divide="ignore", invalid="ignore"):
            values = {n: np.where(x["n_words"] == 0, 0.0, x[count] / x[by]) for n, count, by in rules.scores}
        bad = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
        for same, cuts in groups:
            mine = np.array([v in same for v in langs], bool)
            for n, cut in cuts.items():
                bad |= mine & (values[n] > cut)
        return ~bad

    return keep
