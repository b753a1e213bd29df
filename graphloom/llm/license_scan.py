"""License scan: ordered signature rules over the words of a text, gated by keywords, with priorities and suppression of contained matches.

A text is brought to words (license_rules.py says how). One automaton finds which rules' keywords it holds; only those rules' patterns are searched. Each match is an
interval of words. A match that lies within a match of higher priority, or within a longer one of the same priority (of equal intervals the rule that stands first wins), is suppressed.
Base phrases are matched like the other rules, but nothing suppresses them.

Every text is judged by itself, in a task that holds one batch of texts (2 MB, or one longer text, of which a few copies are held): nothing is shuffled.

Defined results: null and empty texts have no words and no matches; null ids stay null; repeated rows are each judged; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import quoted, short_batches, slices, utf8
from graphloom.llm.license_rules import BASE, CONFIDENCE, parsed

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Priority of the base phrases: below all others, as they never suppress.
_BASE_PRIORITY = 0
SPAN = "struct<label:string,rule:int,priority:int,base:boolean,kept:boolean,first:long,last:long,words:string>"


def as_words(text: bytes) -> bytes:
    """The words of a text, with a space before, between and after them."""
    return re.sub(rb" {2,}", b" ", b" " + text.translate(_WORDS) + b" ")


class Scanner:
    """Compiled rules: (label, priority, keyword, pattern), then the base phrases."""

    def __init__(self, rules: Iterable[tuple[str, int, str, str]], base: dict[str, str]):
        import ahocorasick

        every = [*rules, *((label, _BASE_PRIORITY, phrase, re.escape(phrase)) for phrase, label in base.items())]
        latin = lambda s: s.encode().decode("latin-1")  # noqa: E731  texts are searched byte by byte
        self.labels, self.priority = [r[0] for r in every], np.array([r[1] for r in every], np.int64)
        self.patterns = [re.compile("(?<= )(?:" + latin(re.sub(r"<(\d+)>", r"(?:[^ ]+ ){0,\1}", r[3])) + ")(?= )") for r in every]
        gates: dict[str, list[int]] = {}
        for i, r in enumerate(every):
            gates.setdefault(latin(r[2]), []).append(i)
        self.gates = ahocorasick.Automaton()
        for word, of in gates.items():
            self.gates.add_word(word, of)
        self.gates.make_automaton()

    def matches(self, words: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rule, start, end) of each match, in characters, in order of start."""
        open_ = sorted({i for _, of in self.gates.iter(words) for i in of})
        found = [(m.start(), m.end(), i) for i in open_ for m in self.patterns[i].finditer(words)]
        at = np.array(found, np.int64).reshape(-1, 3)
        at = at[np.lexsort((at[:, 2], at[:, 1], at[:, 0]))]
        return at[:, 2], at[:, 0], at[:, 1]

    def kept(self, rule: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which matches no other suppresses. What suppresses a suppressor suppresses its prey too, so each level of priority takes one sweep."""
        priority = self.priority[rule]
        order = np.lexsort((rule, -priority, -end, start))
        out = np.ones(len(rule), bool)
        for p in np.unique(priority[priority > _BASE_PRIORITY]):
            at = order[priority[order] >= p]
            reach = np.maximum.accumulate(end[at])  # what stands before starts no later, so it contains whatever it reaches beyond
            hit = np.concatenate(([False], reach[:-1] >= end[at][1:]))
            out[at[hit & (priority[at] == p)]] = False
        return out


@cache
def scanner() -> Scanner:
    return Scanner(parsed(), BASE)


def _spans(texts: list[bytes], s: Scanner):
    """n_words and the spans of each text, as Arrow arrays."""
    import pyarrow as pa

    counts, sizes, cols = [], [], [[] for _ in range(8)]
    for t in texts:
        joined = as_words(t)
        counts.append(joined.count(b" ") - 1)
        text = joined.decode("latin-1")
        rule, start, end = s.matches(text)
        sizes.append(len(rule))
        if not len(rule):
            continue
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        first, last = np.searchsorted(spaces, start) - 1, np.searchsorted(spaces, end) - 1
        priority = s.priority[rule]
        for c, v in zip(cols, ([s.labels[i] for i in rule.tolist()], rule, priority, priority == _BASE_PRIORITY, s.kept(rule, start, end), first, last, [joined[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]), strict=True):
            c.extend(v if isinstance(v, list) else v.tolist())
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
    names = [x.split(":")[0] for x in SPAN[7:-1].split(",")]
    rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), rows)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, spans (each match with its label, rule, priority, first and last word, and words; kept is false for suppressed ones)."""
    short_batches(docs.sparkSession)
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        s = scanner()
        for b in slices(batches):
            n, spans = _spans(utf8(b.column("text")), s)
            yield pa.RecordBatch.from_arrays([b.column("id"), n, spans], names=["id", "n_words", "spans"])

    return base.mapInArrow(run, f"id long, n_words long, spans array<{SPAN}>")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score of scan()'s rows. The score is the chance that at least one of
    the kept labels is right, each as sure as its best match (0 without labels)."""
    base, kept = F.filter("spans", lambda x: x["base"]), F.filter("spans", lambda x: x["kept"])
    starts = F.transform(base, lambda x: x["first"])
    names = F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["label"])))
    sure = F.create_map(*[F.lit(x) for kv in {**CONFIDENCE, _BASE_PRIORITY: 0.8}.items() for x in kv])
    best = F.transform(names, lambda n: F.array_max(F.transform(F.filter(kept, lambda x: x["label"] == n), lambda x: F.element_at(sure, x["priority"]))))
    score = 1.0 - F.aggregate(best, F.lit(1.0), lambda a, x: a * (1.0 - x))
    return scanned.select(
        "id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _joined(F.transform(base, lambda x: x["label"])).alias("base_labels"), F.array_join(names, ",").alias("labels"), score.alias("score"),
    )


def spans(scanned: DataFrame) -> DataFrame:
    """One row per match that nothing suppresses: id, label, priority, first, last (words), words."""
    one = scanned.select("id", F.explode("spans").alias("s")).filter("s.kept")
    return one.select("id", "s.label", "s.priority", "s.first", "s.last", "s.words")
