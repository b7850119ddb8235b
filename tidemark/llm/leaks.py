"""Evaluation texts leaking into training text.

Words become templates: numbers, names and units are replaced by typed placeholders, so that a
passage asked again with other values keeps its template. The windows of a template that are joined
are gapped: if a stretch of a document holds at least t of a passage's n words in order, it holds
at least j of any n - t + j of them. So each passage is known by its n - t + j template parts that are
rarest in the corpus, and wherever j words of a document lie within a stretch and hit, through a hash
table of those parts, the same passage, there is a candidate; no leak can be without one. The tables
of all passages are small; they are sent to the tasks in blocks of bounded size, and each task joins its
documents with them and checks every candidate at once, so that no text is shuffled. The check is
exact: bounds that no leak can miss (how many of the passage's words there are at all, and in order over a
longer stretch), then every stretch that could suffice. Last, the values in the shared slots of both
templates are compared: a leak whose slots hold other values is a question asked again with other
parameters.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.sources import stored

#: Words that count as units of measure, time or money.
UNITS = frozenset(
    "second seconds minute minutes hour hours day days week weeks month months year years percent cent cents dollar dollars euro euros pound pounds "
    "thousand million billion trillion g kg mg ton tons tonne tonnes lb lbs oz mm cm m km inch inches foot feet yard yards mile miles ml l litre litres liter liters gallon gallons degree degrees".split()
)
NUMBER, UNIT, NAME = "#", "%", "@"

_MARKUP = re.compile(r"<[^<>\n]{1,60}>")
_WORD = re.compile(r"[^\W_]+")
_INNER = re.compile(r"(?<=[\w,;’'] )([A-Z][^\W\d_]+)")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def plain_words(text: str) -> list[str]:
    """The words of a text without markup, typographic variants and invisible characters, in their case."""
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    return _WORD.findall(text)


def part_of(word: str, names) -> str:
    """The template part of a word in lower case."""
    return NUMBER if word[0].isdigit() else UNIT if word in UNITS else NAME if word in names else word


def template(words: list[str], names) -> tuple[list[str], list[int]]:
    """The template of words, neighbouring names as one, and the index of the word at which each part begins."""
    parts: list[str] = []
    starts: list[int] = []
    for i, word in enumerate(words):
        part = part_of(word.lower(), names)
        if part != NAME or not parts or parts[-1] != NAME:
            parts.append(part)
            starts.append(i)
    return parts, starts


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word of the passages with its place; whether it stands capitalised within a sentence, or in lower case."""
    for batch in batches:
        for item, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = plain_words(text or "")
            inner = {w.lower() for w in _INNER.findall(text or "")}
            low = [w.lower() for w in words]
            yield pa.RecordBatch.from_arrays(
                [pa.array([item.as_py()] * len(words), batch.column(0).type), pa.array(range(len(words)), pa.int32()), pa.array(words, pa.string()), pa.array(low, pa.string()), pa.array([w in inner for w in low], pa.bool_())],
                names=["item", "place", "word", "low", "capital"],
            )


def known_passages(passages: DataFrame, texts: DataFrame, share: float, spare: float) -> DataFrame:
    """item, needed (words), hits (of rare parts), told: an array of (place, word, part, rare, name)."""
    kind = passages.schema["item"].dataType.simpleString()
    words = stored(passages.mapInArrow(_places, f"item {kind}, place int, word string, low string, capital boolean"))
    lower = F.max((F.col("word") == F.col("low")).cast("int"))
    seen = words.groupBy("low").agg(F.max(F.col("capital").cast("int")).alias("capital"), lower.alias("lower"))
    seen = seen.select("low", ((F.col("capital") == 1) & (F.col("lower") == 0)).alias("name"))
    low = F.col("low")
    part = F.when(low.rlike("^\\p{Nd}"), NUMBER).when(low.isin(*UNITS), UNIT).when(F.col("name"), NAME).otherwise(low)
    # how often the corpus uses each part; numbers, of which it has others too, count as the commonest
    used = texts.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("low")).join(seen, "low", "left_semi").groupBy("low").agg(F.count("*").alias("uses"))
    seen = stored(seen.join(used, "low", "left").withColumn("part", part))
    uses = F.when(F.col("part") == NUMBER, F.lit(2**62)).otherwise(F.coalesce(F.sum("uses"), F.lit(0)))
    seen = seen.drop("uses").join(seen.groupBy("part").agg(uses.alias("uses")), "part")
    sizes = words.groupBy("item").agg(F.count("*").alias("n")).withColumn("needed", F.ceil(F.col("n") * share))
    sizes = sizes.withColumn("hits", F.greatest(F.lit(1), F.ceil(F.col("needed") * spare)))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("uses", "part", "place"))  # a passage's words
    ranked = words.join(seen, "low").join(sizes, "item").withColumn("rare", rank <= F.col("n") - F.col("needed") + F.col("hits"))
    told = F.sort_array(F.collect_list(F.struct("place", "word", "part", "rare", "name")))
    return ranked.groupBy("item", "needed", "hits").agg(told.alias("told"))


def longest_common(masks: Sequence[int], n: int) -> int:
    """Length of the longest common subsequence, a bit per word of the passage; a mask per word of the document."""
    ones = (1 << n) - 1
    state = ones
    for mask in masks:
        hit = state & mask
        state = ((state + hit) | (state - hit)) & ones
    return n - state.bit_count()


class Passages:
    """A block of passages as the tasks see it."""

    def __init__(self, rows: Sequence[Row], stretch: float) -> None:
        self.items = [row["item"] for row in rows]
        self.words = [[t["word"] for t in row["told"]] for row in rows]
        self.needed = np.array([row["needed"] for row in rows], np.int64)
        self.hits = np.array([row["hits"] for row in rows], np.int64)
        self.room = np.array([int(stretch * len(w)) for w in self.words], np.int64)
        self.names = frozenset(t["word"].lower() for row in rows for t in row["told"] if t["name"])
        self.masks: list[dict[str, int]] = []
        for words in self.words:
            own: dict[str, int] = defaultdict(int)
            for i, word in enumerate(words):
                own[word.lower()] |= 1 << i
            self.masks.append(dict(own))
        self.numbers = {w: i for i, w in enumerate(sorted({w for own in self.masks for w in own}))}
        self.counts = np.zeros((len(rows), len(self.numbers)), np.uint16)
        for i, own in enumerate(self.masks):
            for word, mask in own.items():
                self.counts[i, self.numbers[word]] = mask.bit_count()
        holders: dict[str, set[int]] = defaultdict(set)
        for i, row in enumerate(rows):
            for t in row["told"]:
                if t["rare"]:
                    holders[t["part"]].add(i)
        parts = {part: number for number, part in enumerate(sorted(holders))}
        self.lengths = np.array([len(holders[p]) for p in parts], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.holders = np.array([i for p in parts for i in sorted(holders[p])], np.int64)
        self.number = parts.get(NUMBER, -1)
        self.parts = {w: parts.get(UNIT, -1) for w in UNITS} | {w: parts.get(NAME, -1) for w in self.names if w not in UNITS}
        self.parts = {p: n for p, n in parts.items() if p not in (NUMBER, UNIT, NAME)} | self.parts
        self.fewest, self.longest = int(self.hits.min()), int(self.room.max())

    def hit_parts(self, low: list[str]) -> np.ndarray:
        """The number of the part of each word of a document, -1 if no passage is known by it."""
        get, number = self.parts.get, self.number
        if number < 0:
            return np.array([get(w, -1) for w in low], np.int64)
        return np.array([number if w[0].isdigit() else get(w, -1) for w in low], np.int64)

    def dense(self, places: np.ndarray) -> bool:
        """Whether hits, of whatever passage, lie close enough together anywhere."""
        n = self.fewest
        return len(places) >= n and bool((places[n - 1 :] - places[: len(places) - n + 1] < self.longest).any())

    def possible(self, low: list[str]) -> np.ndarray:
        """For tiles of a document, each of twice the longest stretch and half over the next: whether it
        holds enough of the words of each passage, in any order. A stretch lies in the tile in whose first
        half it begins."""
        known = np.array([self.numbers.get(w, -1) for w in low], np.int64)
        out = np.zeros((len(low) // self.longest + 1, len(self.items)), bool)
        for tile in range(len(out)):
            own = known[tile * self.longest : (tile + 2) * self.longest]
            words, seen = np.unique(own[own >= 0], return_counts=True)
            out[tile] = np.minimum(self.counts[:, words], seen.astype(np.uint16)).sum(1) >= self.needed
        return out

    def candidates(self, docs: np.ndarray, places: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, passages, and places of hits that begin a stretch with enough of them, in order,
        for words of documents, in order, that hit some passage."""
        lengths = self.lengths[parts]
        upto = np.cumsum(lengths)
        which = self.holders[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.begins[parts] - (upto - lengths), lengths)]
        pair = np.repeat(docs, lengths) * len(self.items) + which
        order = np.argsort(pair, kind="stable")
        pair, at, which = pair[order], np.repeat(places, lengths)[order], which[order]
        last = np.arange(len(pair)) + self.hits[which] - 1
        inside = last < len(pair)
        last = np.minimum(last, max(0, len(pair) - 1))
        good = np.flatnonzero(inside & (pair[last] == pair) & (at[last] - at < self.room[which]))
        return pair[good] // len(self.items), which[good], at[good]

    def best_stretch(self, low: list[str], passage: int, begins: np.ndarray) -> tuple[int, int]:
        """(most words of the passage in order within a stretch, where that stretch begins), if at least
        the needed number, else (0, 0). begins are the places that candidates gave."""
        masks, n, room, best, where = self.masks[passage], len(self.words[passage]), int(self.room[passage]), int(self.needed[passage]) - 1, 0
        # a sufficient stretch holds one of the candidates' stretches
        gaps = np.flatnonzero(np.diff(begins) > 2 * room) + 1
        for own in np.split(begins, gaps):
            lo = max(0, int(own[0]) - room)
            said = [(i, m) for i, w in enumerate(low[lo : int(own[-1]) + 2 * room], lo) if (m := masks.get(w))]
            if len(said) <= best or longest_common([m for _, m in said], n) <= best:
                continue
            places = np.array([i for i, _ in said], np.int64)
            # a best stretch may begin at a word of the passage; it has no more in order than in all
            held = np.searchsorted(places, places + room) - np.arange(len(places))
            for i in np.argsort(-held, kind="stable").tolist():
                if held[i] <= best:
                    break
                found = longest_common([m for _, m in said[i : i + held[i]]], n)
                if found > best:
                    best, where = found, said[i][0]
        return (best, where) if best >= self.needed[passage] else (0, 0)

    def slots(self, said: list[str], passage: int, width: int) -> tuple[float, float]:
        """(consistency of the slots, share of slots that hold the passage's value): where windows of
        both templates agree, the values of their numbers and names, and of what stands for these."""
        asked = self.words[passage]
        known = self.masks[passage]
        parts, starts = template(asked, self.names)
        others = {w.lower() for w in said if w[0].isupper() and w.lower() not in known}
        there, begins = template(said, self.names | others)
        ends, there_ends = [*starts[1:], len(asked)], [*begins[1:], len(said)]
        places: dict[tuple, list[int]] = defaultdict(list)
        for i in range(len(parts) - width + 1):
            places[tuple(parts[i : i + width])].append(i)
        mapped: dict[str, Counter] = defaultdict(Counter)
        for j in range(len(there) - width + 1):
            for i in places.get(tuple(there[j : j + width]), ()):
                for s in range(width):
                    if parts[i + s] in (NUMBER, NAME):
                        value = " ".join(asked[starts[i + s] : ends[i + s]]).lower()
                        mapped[value][" ".join(said[begins[j + s] : there_ends[j + s]]).lower()] += 1
        seen = sum(sum(c.values()) for c in mapped.values())
        if not seen:
            return 1.0, 1.0
        return sum(max(c.values()) for c in mapped.values()) / seen, sum(c[value] for value, c in mapped.items()) / seen


def _leaks(known, width: int, room: int, schema: pa.Schema):
    def leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages: Passages = known.value
        for batch in batches:
            found: list[tuple] = []
            held: list[tuple] = []
            size = 0

            def settle() -> None:
                docs, which, begins = passages.candidates(*(np.concatenate([h[i] for h in held]) for i in (2, 3, 4)))
                for own in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(docs)) + 1) if len(docs) else ():
                    key, words = held[docs[own[0]]][:2]
                    low = [w.lower() for w in words]
                    possible, tiles = passages.possible(low), begins[own] // passages.longest
                    # a sufficient stretch begins less than its length before the hits
                    own = own[possible[tiles, which[own]] | possible[np.maximum(tiles - 1, 0), which[own]]]
                    for pair in np.split(own, np.flatnonzero(np.diff(which[own])) + 1) if len(own) else ():
                        passage = int(which[pair[0]])
                        best, start = passages.best_stretch(low, passage, begins[pair])
                        if best:
                            consistent, equal = passages.slots(words[start : start + int(passages.room[passage])], passage, width)
                            found.append((key, passages.items[passage], best / len(passages.words[passage]), consistent, equal))
                held.clear()

            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or key is None:
                    continue
                words = plain_words(text)
                parts = passages.hit_parts([w.lower() for w in words])
                places = np.flatnonzero(parts >= 0)
                if not passages.dense(places):
                    continue
                held.append((key, words, np.full(len(places), len(held)), places, parts[places]))
                size += int(passages.lengths[parts[places]].sum())
                if size > room:
                    settle()
                    size = 0
            if held:
                settle()
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], schema.field(i).type) for i in range(5)], schema=schema)

    return leaks


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc: tuple[str, str],
    item: tuple[str, str],
    share: float = 0.5,
    stretch: float = 2.0,
    spare: float = 0.2,
    width: int = 3,
    block: int = 2_000,
    room: int = 2_000_000,
) -> DataFrame:
    """doc, item, share, consistency, kind (`verbatim` or `reparameterised`) of every leaked item: at
    least `share` of the passage's words stand in its order within a stretch of at most `stretch`
    times its length; nothing else decides.

    doc and item name the id and text columns; ids must be unique. spare is the j of the gapped windows
    as a part of the words needed: it decides how many candidates are checked, never what is found.
    Slots are compared where windows of `width` template parts agree. Null and empty texts leak nothing.
    Copies of a document each come out. An empty side gives no rows; other columns are left out.
    Passages go to the tasks in blocks of about `block`, each with a pass over the documents; a task
    holds about `room` hits at a time, of one document at least.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(doc[0]).alias("doc"), F.col(doc[1]).alias("text"))
    passages = items.select(F.col(item[0]).alias("item"), F.col(item[1]).alias("passage")).where("item is not null and passage <> ''")
    told = stored(known_passages(passages, texts, share, spare))
    blocks = ceil(told.count() / block)
    kinds = [texts.schema["doc"].dataType, passages.schema["item"].dataType]
    schema = pa.schema([(c, to_arrow_type(k)) for c, k in zip(("doc", "item"), kinds, strict=True)] + [(c, pa.float64()) for c in ("share", "consistency", "equal")])
    ddl = f"doc {kinds[0].simpleString()}, item {kinds[1].simpleString()}, share double, consistency double, equal double"
    found = [spark.createDataFrame([], ddl)]
    for number in range(blocks):
        own = told.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).orderBy("item").collect()  # about `block` rows
        known = spark.sparkContext.broadcast(Passages(own, stretch))
        found.append(texts.mapInArrow(_leaks(known, width, room, schema), ddl))
    kind = F.when(F.col("equal") >= 0.5, "verbatim").otherwise("reparameterised")
    return reduce(DataFrame.unionByName, found[1:] or found).select("doc", "item", "share", "consistency", kind.alias("kind"))
