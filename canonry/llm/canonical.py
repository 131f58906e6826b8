"""Freely typed values mapped to a canonical list (problem 5)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.session import scans, written

#: Titles and offices before or after a name, without accents.
TITLES = (
    "tm", "kt", "tl", "tuq", "q", "ong", "ba", "ts", "ths", "pgs", "gs", "bs", "ks", "ls", "mr", "mrs", "ms", "dr",
    "chu tich", "pho chu tich", "bo truong", "thu truong", "giam doc", "pho giam doc", "quyen giam doc", "cuc truong", "pho cuc truong", "vu truong", "chanh van phong",
)
#: Abbreviations inside a name.
SHORT = {"t": "tinh", "tp": "thanh pho", "tx": "thi xa"}
#: Texts that hold no value.
NO_VALUE = ("", "n/a", "nan")

_TITLE = re.compile(r"^(?:(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\b[. ]*)+(?=\S+ \S)")
_NOTE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_TOKEN = re.compile(r"[a-z0-9]+")


def folded(text: str) -> str:
    """Lower case, without accents, đ as d."""
    text = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in text if not unicodedata.combining(c)).replace("đ", "d")


def normalise(text: str, person: bool) -> str:
    """The bare name in a typed value: notes in brackets, a label before a colon, titles, punctuation and, for a person, the order `last, first` are undone."""
    text = folded(_NOTE.sub(" ", text) if _NOTE.sub("", text).strip() else text)
    label, _, rest = text.rpartition(":")
    if label and _TOKEN.search(rest):
        text = rest
    if person and text.count(",") == 1:
        last, first = text.split(",")
        if _TOKEN.search(last) and _TOKEN.search(first):
            text = f"{first} {last}"
    dotted = re.sub(r"\b(" + "|".join(SHORT) + r")\.", lambda m: SHORT[m[1]] + " ", text)
    name = " ".join(_TOKEN.findall(dotted))
    bare = _TITLE.sub("", name)
    return bare or name


def grams(name: str) -> Counter:
    """Character trigrams of the words of a name, with their ends marked."""
    out: Counter = Counter()
    for word in name.split():
        padded = f" {word} "
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or `most` + 1 if it is more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before: list[int] = []
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        new[0] = i if i <= most else far
        for j in range(low, high + 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, before[j - 2] + 1)
            new[j] = v
        if min(new[low - 1 : high + 1]) > most:
            return far
        before, row = row, new
    return min(row[-1], far)


#: Names of four letters to fewer than this may differ from an entry by one letter, longer ones by one in eight, `slack` at most.
_SHORT_NAME = 16
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "
_PLACE = {c: i for i, c in enumerate(_ALPHABET)}


def _room(name: str, slack: int) -> int:
    return min(slack, max(1, len(name) // 8)) if len(name) > 3 else 0


def _ordered(name: str) -> str:
    return " ".join(sorted(name.split()))


def _letters(names: list[str]) -> np.ndarray:
    """How often each letter occurs in each name."""
    out = np.zeros((len(names), len(_ALPHABET)), np.int32)
    for i, name in enumerate(names):
        for c, n in Counter(name).items():
            if c in _PLACE:
                out[i, _PLACE[c]] = n
    return out


def _shortened(name: str) -> set[str]:
    """A name and all that is left of it without one letter; two names one edit apart share one of these."""
    return {name, *(name[:i] + name[i + 1 :] for i in range(len(name)))}


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers begin[i], begin[i] + 1, ... of each i, `count[i]` of them."""
    return np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


@dataclass
class Hit:
    """An entry that may be meant: its id, cosine, and edit distance (large where it wasn't needed)."""

    id: int
    cosine: float
    distance: int


FAR = 99


@dataclass
class Matcher:
    """Inverted index of the trigrams of one kind of entries."""

    ids: np.ndarray
    names: list[str]
    literal: frozenset[str]
    grams: dict[str, int]
    idf: dict[str, float]  # of all trigrams of the whole list
    unknown: float
    begin: np.ndarray  # of each trigram's postings
    entry: np.ndarray
    cell: np.ndarray  # entry * trigrams + trigram, sorted
    weight: np.ndarray  # in the order of `cell`
    letters: np.ndarray
    short: dict[str, list[int]]
    person: bool

    @classmethod
    def build(cls, entries: list[tuple[int, str, str | None]], person: bool = False, counts: Counter | None = None, total: int | None = None) -> Matcher:
        """An index over canonical names and short forms; `counts` and `total` are those of the whole list where `entries` is a block of it."""
        ids, names = [], []
        for number, name, short in entries:
            for text in spellings(name, short):
                ids.append(number)
                names.append(normalise(text, person))
        own = [grams(n) for n in names]
        df = Counter(g for c in own for g in c) if counts is None else counts
        total = len(names) if total is None else total
        number = {g: i for i, g in enumerate(sorted({g for c in own for g in c}))}
        idf = {g: math.log(1 + total / n) for g, n in df.items()}
        cells, weights = [], []
        for e, c in enumerate(own):
            norm = math.sqrt(sum((n * idf[g]) ** 2 for g, n in c.items())) or 1.0
            for g in sorted(c, key=number.__getitem__):
                cells.append(e * len(number) + number[g])
                weights.append(c[g] * idf[g] / norm)
        cell = np.array(cells, np.int64)
        gram = cell % max(len(number), 1)
        by_gram = np.argsort(gram, kind="stable")
        begin = np.concatenate(([0], np.cumsum(np.bincount(gram, minlength=len(number))))).astype(np.int64)
        near = defaultdict(list)
        for e, name in enumerate(names):
            if len(name) <= _SHORT_NAME:
                for key in _shortened(name) | _shortened(_ordered(name)):
                    near[key].append(e)
        return cls(
            np.array(ids, np.int64), names, frozenset(n for _, n, _ in entries if n), number, idf, math.log(1 + total), begin, cell[by_gram] // max(len(number), 1),
            cell, np.array(weights), _letters(names), dict(near), person,
        )

    def _pairs(self, names: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Name, entry and cosine of every pair whose cosine may reach `least`, and of every pair of short names one edit apart.

        The postings of a name's trigrams are read from the shortest list on,
        until what is left of the name is shorter than `least`: an entry that
        shares only such trigrams can't reach it.
        """
        row, gram, weight, extra = [], [], [], []
        for r, name in enumerate(names):
            w = {g: n * self.idf.get(g, self.unknown) for g, n in grams(name).items()}
            norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
            for g, x in w.items():
                if g in self.grams:
                    row.append(r)
                    gram.append(self.grams[g])
                    weight.append(x / norm)
            if 3 < len(name) < _SHORT_NAME:
                extra += [(r, e) for e in {e for key in _shortened(name) | _shortened(_ordered(name)) for e in self.short.get(key, ())}]
        row, gram, weight = np.array(row, np.int64), np.array(gram, np.int64), np.array(weight)
        size = self.begin[gram + 1] - self.begin[gram]
        order = np.lexsort((size, row))
        row, gram, weight, size = row[order], gram[order], weight[order], size[order]
        ends = np.searchsorted(row, np.arange(len(names)), "right")
        through = np.cumsum(weight * weight)
        left = np.concatenate((through, [0.0]))[ends[row] - 1] - through + weight * weight
        read = left >= least * least - 1e-9
        entries = self.entry[_ranges(self.begin[gram[read]], size[read])]
        pair = np.repeat(row[read], size[read]) * len(self.names) + entries
        if extra:
            pair = np.concatenate((pair, [r * len(self.names) + e for r, e in extra]))
        pair = np.unique(pair)
        r, e = pair // len(self.names), pair % len(self.names)
        # the whole product, over all trigrams of the name
        start = np.searchsorted(row, r)
        count = ends[r] - start
        at = _ranges(start, count)
        sought = np.repeat(e, count) * len(self.grams) + gram[at]
        spot = np.minimum(np.searchsorted(self.cell, sought), len(self.cell) - 1)
        part = np.where(self.cell[spot] == sought, self.weight[spot] * weight[at], 0.0)
        cosine = np.bincount(np.repeat(np.arange(len(r)), count), part, minlength=len(r))
        known = np.zeros(len(r), bool)
        if extra:
            known = np.isin(pair, np.array([a * len(self.names) + b for a, b in extra]))
        keep = (cosine >= least) | known
        return r[keep], e[keep], cosine[keep]

    def match(self, values: list[str], least: float, sure: float, margin: float, slack: int, at_once: int = 4096) -> list[list[Hit]]:
        """The hits of each value that can decide: the two best entries by cosine and the two nearest by spelling."""
        wanted = [normalise(v, self.person) for v in values]
        distinct = sorted(set(wanted))
        found: dict[str, list[Hit]] = {}
        for a in range(0, len(distinct), at_once):
            names = distinct[a : a + at_once]
            found.update(zip(names, self._hits(names, least, sure, margin, slack) if self.names else [[] for _ in names]))
        return [found[n] for n in wanted]

    def _hits(self, names: list[str], least: float, sure: float, margin: float, slack: int) -> list[list[Hit]]:
        r, e, cosine = self._pairs(names, least)
        ids = self.ids[e]
        best = np.lexsort((ids, -cosine, r))
        r, e, cosine, ids = r[best], e[best], cosine[best], ids[best]
        bounds = np.searchsorted(r, np.arange(len(names) + 1))
        room = np.array([_room(n, slack) for n in names])
        # one edit changes the counts of two letters by one
        possible = np.abs(_letters(names)[r] - self.letters[e]).sum(axis=1) <= 2 * room[r]
        out = []
        for i, name in enumerate(names):
            low, high = bounds[i], bounds[i + 1]
            top: dict[int, Hit] = {}
            for j in range(low, high):
                if int(ids[j]) not in top:
                    top[int(ids[j])] = Hit(int(ids[j]), float(cosine[j]), FAR)
                    if len(top) == 2:
                        break
            hits = list(top.values())
            if not accepted(hits, sure, margin):
                near: dict[int, Hit] = {}
                for j in low + np.flatnonzero(possible[low:high]):
                    d = edits(name, self.names[e[j]], int(room[i]))
                    if d > room[i]:
                        d = edits(_ordered(name), _ordered(self.names[e[j]]), int(room[i]))
                    number = int(ids[j])
                    if d <= room[i] and (number not in near or (near[number].distance, -near[number].cosine) > (d, -cosine[j])):
                        near[number] = Hit(number, float(cosine[j]), d)
                hits = sorted(near.values(), key=lambda h: (h.distance, -h.cosine, h.id))[:2] + [h for h in hits if h.id not in near]
            out.append(hits)
        return out


def spellings(name: str | None, short: str | None) -> list[str]:
    """The forms of an entry that values are compared with."""
    return [t for t in (name, short) if t and t.strip()]


def accepted(hits: list[Hit], sure: float, margin: float) -> Hit | None:
    """The entry of highest cosine if it reaches `sure` and leads the next entry by `margin`."""
    ranked = sorted(hits, key=lambda h: (-h.cosine, h.id))
    if ranked and ranked[0].cosine >= sure and (len(ranked) == 1 or ranked[0].cosine - ranked[1].cosine >= margin):
        return ranked[0]
    return None


def decide(hits: list[Hit], sure: float, margin: float) -> tuple[int, float]:
    """The id (0: none) and cosine for a value.

    An entry above the threshold that leads by the margin is taken. Between
    `least` and the threshold, or where two entries are close, the spelling
    decides: the entry within the allowed edits that is nearest, or leads an
    equally near one by the margin.
    """
    if best := accepted(hits, sure, margin):
        return best.id, best.cosine
    near = sorted((h for h in hits if h.distance < FAR), key=lambda h: (h.distance, -h.cosine, h.id))
    if near and not (len(near) > 1 and near[1].distance == near[0].distance and near[0].cosine - near[1].cosine < margin):
        return near[0].id, near[0].cosine
    return 0, max((h.cosine for h in hits), default=0.0)


def _blocks(canon: DataFrame, most_postings: int) -> Iterator[tuple[dict[str, Matcher], bool]]:
    """Indexes of at most `most_postings` trigrams each over the list in the order of its ids, and whether it is the only one; weights are those of the whole list."""
    rows = canon.where(F.col("kind").isNotNull() & F.col("canon_name").isNotNull()).select("kind", "canon_id", "canon_name", "short_form")
    counts, total, postings = defaultdict(Counter), Counter(), 0
    for r in rows.toLocalIterator():
        for text in spellings(r.canon_name, r.short_form):
            c = grams(normalise(text, r.kind == "signer"))
            counts[r.kind].update(c.keys())
            total[r.kind] += 1
            postings += len(c)
    if postings > most_postings:
        rows = rows.orderBy("canon_id")
    held, size = defaultdict(list), 0
    for r in rows.toLocalIterator():
        new = sum(len(t) + 2 for t in spellings(r.canon_name, r.short_form))
        if size and size + new > most_postings:
            yield {k: Matcher.build(v, k == "signer", counts[k], total[k]) for k, v in held.items()}, False
            held, size = defaultdict(list), 0
        held[r.kind].append((r.canon_id, r.canon_name, r.short_form))
        size += new
    yield {k: Matcher.build(v, k == "signer", counts[k], total[k]) for k, v in held.items()}, size <= most_postings and postings <= most_postings


_HITS = "array<struct<id: bigint, cosine: double, distance: int>>"


def map_values(
    values: DataFrame, canon: DataFrame, least: float = 0.3, sure: float = 0.85, margin: float = 0.02, slack: int = 2, most_postings: int = 4_000_000, most_broadcast: int = 16 << 20,
) -> DataFrame:
    """`values` with `canon_id` (0: none) and `score` for every value that is not literally a canonical name.

    `values` has `kind`, `raw` and any other columns; one named like a result is replaced;
    `canon` has `kind`, `canon_id`, `canon_name`, `short_form`. The distinct
    values are normalised and looked up in an inverted index of character
    trigrams. Every entry whose weighted cosine reaches `least` is a
    candidate, as is, for names under 16 letters, every entry one edit away,
    whose cosine may be lower; there is no limit on their number. A value
    takes the entry whose cosine reaches `sure` and leads the next by
    `margin`; short of that the spelling decides (see `decide`). Null, blank
    and sentinel values give no row; repeated rows stay.

    Distinct values meet the index in partitions of their own, so a frequent
    value is matched once. The answers are sent to the rows where they have
    at most `most_broadcast` characters and joined by shuffle otherwise,
    where adaptive execution splits a frequent value. The list goes to the
    executors in blocks of at most `most_postings` trigrams; beyond one
    block, each is a pass over the distinct values that ends before the next.
    """
    spark = values.sparkSession
    rows = values.where(F.col("raw").isNotNull() & ~F.lower(F.trim("raw")).isin(*NO_VALUE))
    rest = [c for c in rows.columns if c not in ("kind", "raw", "canon_id", "score")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    distinct, _ = written(rows.select("kind", "raw").distinct().repartition(parts, "kind", "raw"))

    def scan(shared) -> DataFrame:
        # where other blocks may have a nearer entry, the spelling is always looked at
        taken = sure if shared.value[1] else 2.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matchers = shared.value[0]
            for batch in batches:
                kinds, raws = batch["kind"].to_pylist(), batch["raw"].to_pylist()
                found, literal = [[] for _ in raws], [False] * len(raws)
                for kind, matcher in matchers.items():
                    own = [i for i, k in enumerate(kinds) if k == kind]
                    for i, hits in zip(own, matcher.match([raws[i] for i in own], least, taken, margin, slack)):
                        found[i], literal[i] = [(h.id, h.cosine, h.distance) for h in hits], raws[i] in matcher.literal
                blank = [not r.strip() for r in raws]
                kind_of = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("distance", pa.int32())]))
                lists = pa.array([[dict(zip(("id", "cosine", "distance"), h)) for h in hits] for hits in found], kind_of)
                yield pa.RecordBatch.from_arrays([batch["kind"], batch["raw"], pa.array([a or b for a, b in zip(literal, blank)]), lists], ["kind", "raw", "literal", "hits"])

        return distinct.mapInArrow(run, f"kind string, raw string, literal boolean, hits {_HITS}")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [decide([Hit(**h) for h in hits], sure, margin) for hits in batch["hits"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["kind"], batch["raw"], pa.array([i for i, _ in ends], pa.int64()), pa.array([s for _, s in ends], pa.float64())], ["kind", "raw", "canon_id", "score"])

    passes = scans(spark, _blocks(canon, most_postings), scan)
    hits = passes[0]
    if len(passes) > 1:
        every = reduce(DataFrame.unionByName, passes).groupBy("kind", "raw")
        hits = every.agg(F.bool_or("literal").alias("literal"), F.flatten(F.collect_list("hits")).alias("hits"))
    answers = hits.where(~F.col("literal")).select("kind", "raw", "hits").mapInArrow(settle, "kind string, raw string, canon_id bigint, score double")
    answers, _ = written(answers)
    size = answers.agg(F.coalesce(F.sum(F.length("raw") + 40), F.lit(0)).alias("n")).first().n
    answers = answers.withColumnsRenamed({"kind": "__kind", "raw": "__raw"})
    asked = rows.select("kind", "raw", *rest)
    same = asked["kind"].eqNullSafe(F.col("__kind")) & (asked["raw"] == F.col("__raw"))
    out = asked.join(F.broadcast(answers) if size <= most_broadcast else answers, same)
    return out.select("kind", "raw", *rest, "canon_id", "score")
