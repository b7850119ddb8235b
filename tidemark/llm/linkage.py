"""Matching entities across sources without keys, by a label model.

Both sides are broken into (entity, field, value) rows. Candidates share a blocking key: an equal or
nearly equal identifier, ticker or name stem. For each candidate every field is a heuristic matcher
that votes with a level of agreement, or abstains. A generative model with one hidden class (same or
not) learns from the vote patterns of all candidates, without labels, how often each matcher casts
each level in either class, and which matchers depend on each other beyond that; dependent ones are
modelled jointly. Its posterior is the confidence.

Only the table of vote patterns comes to the driver: at most (levels+1)^matchers rows, whatever the
number of candidates.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources import stored

FIELDS = ("cusip", "isin", "ticker", "name", "form")
ABSTAIN = -1
LEVELS = 4  #: 0 conflict, 1 and 2 partial, 3 full agreement

#: Legal forms and other words that say little about who a company is.
FORMS = {"INCORPORATED": "INC", "INC": "INC", "CORPORATION": "CORP", "CORP": "CORP", "COMPANY": "CO", "CO": "CO", "LIMITED": "LTD", "LTD": "LTD"}
FOREIGN_FORMS = ("PLC", "AG", "NV", "SE", "SA", "AB", "OYJ", "SPA", "ASA", "KK", "GMBH", "BV", "AS")
EMPTY_WORDS = ("THE", "GROUP", "HOLDINGS", "HOLDING", "HLDGS", "GRP", "OLD", "NEW")


def _blank(text: Column) -> Column:
    t = F.upper(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.when(~t.isin("", "N/A", "NA", "NONE", "NULL", "-"), t)


def _folded(identifier: Column) -> Column:
    """An identifier without separators, letters and digits that look alike made one."""
    return F.translate(F.regexp_replace(_blank(identifier), "[^A-Z0-9]", ""), "OI", "01")


def _name_words(name: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(_blank(name), r"[.'’]", ""), r"[^\p{L}\p{N}]+", " ")), " ")


def identity_fields(cusip: Column, ticker: Column, isin: Column | None, name: Column) -> list[Column]:
    """struct(field, value) for each field that says something."""
    c = _folded(cusip)
    fields = [("cusip", F.when(F.length(c) >= 6, F.substring(c, 1, 8)))]
    if isin is not None:
        i = _folded(isin)
        fields.append(("isin", F.when(F.length(i) >= 8, F.when(F.substring(i, 1, 2) == "US", F.substring(i, 3, 8)).otherwise(F.lit("abroad")))))
    fields.append(("ticker", F.regexp_extract(_blank(ticker), "^([A-Z0-9]+)", 1)))
    words = _name_words(name)
    form = lambda w: w.isin(*FORMS, *FOREIGN_FORMS, *EMPTY_WORDS)
    core = F.filter(words, lambda w: ~form(w))
    fields.append(("name", F.array_join(core, " ")))
    table = F.create_map(*[F.lit(x) for pair in FORMS.items() for x in pair], *[F.lit(x) for f in FOREIGN_FORMS for x in (f, "ABROAD")])
    last = F.element_at(F.filter(words, lambda w: w.isin(*FORMS, *FOREIGN_FORMS)), -1)
    fields.append(("form", F.when(F.size(F.filter(words, lambda w: w.isin(*FORMS, *FOREIGN_FORMS))) > 0, table[last])))
    return [F.struct(F.lit(f).alias("field"), F.when(v != "", v).alias("value")) for f, v in fields]


def _deletions(word: Column) -> Column:
    """The word and every form of it that lacks one letter: words one slip apart share one."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), word.substr(i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def blocking_keys(rows: DataFrame, entity: str) -> DataFrame:
    """entity, key: what two records of one company are expected to share at least once; copies may occur."""
    value, field = F.col("value"), F.col("field")
    stem = F.substring_index("value", " ", 1)
    prefixed = lambda mark, words: F.transform(words, lambda w: F.concat(F.lit(mark), w))
    keys = (
        F.when(field.isin("cusip", "isin") & (F.length(value) == 8) & (value != "abroad"), prefixed("c:", _deletions(value)))
        .when(field == "ticker", F.array(F.concat(F.lit("t:"), value)))
        .when((field == "name") & (F.length(stem) >= 4), prefixed("n:", _deletions(stem)))
    )
    return rows.where("field <> 'form'").select(entity, F.explode(keys).alias("key"))


def blocked_pairs(units: DataFrame, entities: DataFrame, most: int = 256) -> DataFrame:
    """unit, entity of all pairs that share a key. The entities of a key, if more than `most`, are split
    into parts, and the key's units meet each part: all pairs, in tasks of bounded width."""
    entities = stored(entities.distinct())
    heavy = stored(entities.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    # written, so that Spark knows its size and need not shuffle the units if it is small
    split = stored(entities.join(heavy, "key", "left").select("entity", "key", F.pmod(F.xxhash64("entity"), parts).cast("int").alias("part")))
    spread = units.join(heavy, "key", "left").select("unit", "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return spread.join(split, ["key", "part"]).select("unit", "entity").distinct()


def _agreement(left: Column, right: Column, field: Column) -> Column:
    near = lambda a, b, most: F.levenshtein(a, b, most) >= 0
    identifier = (
        F.when(left == right, 3)
        .when((F.length(left) < 8) & F.startswith(right, left), 2)
        .when(near(left, right, 1), 2)
        .when(F.substring(left, 1, 6) == F.substring(right, 1, 6), 1)
        .otherwise(0)
    )
    ticker = F.when(left == right, 3).when((F.length(left) >= 3) & near(left, right, 1), 1).otherwise(0)
    stems = [F.substring_index(x, " ", 1) for x in (left, right)]
    rests = [F.substring_index(x, " ", -1) for x in (left, right)]
    same_stem = near(*stems, 2) & (F.length(stems[0]) >= 4)
    rest_near = near(*rests, 2) | ((F.length(rests[0]) >= 3) & F.startswith(rests[1], rests[0])) | (F.size(F.split(left, " ")) == 1)
    name = F.when(left == right, 3).when(same_stem & rest_near, 2).when(same_stem, 1).otherwise(0)
    form = F.when(left == right, 3).when(left == "ABROAD", 0).otherwise(1)
    return F.when(field.isin("cusip", "isin"), identifier).when(field == "ticker", ticker).when(field == "name", name).otherwise(form)


def _by_field(rows: DataFrame, key: str, value: Column, fields: tuple[str, ...]) -> DataFrame:
    """One row per key: for every field the array of what it says."""
    return rows.groupBy(key).agg(*[F.collect_list(F.when(F.col("field") == f, value)).alias(f"{key}_{f}") for f in fields])


def _vote(field: str) -> Column:
    """The level that most of a unit's records reach with some value the entity ever had; abstains without values."""
    told, known = F.col(f"unit_{field}"), F.col(f"entity_{'cusip' if field == 'isin' else field}")
    level = lambda v: F.array_max(F.transform(known, lambda k: _agreement(v["value"], k, F.lit(field))))
    levels = F.transform(told, lambda v: F.struct(v["n"].alias("n"), level(v).alias("level")))

    def reached(at: int) -> Column:
        n = F.aggregate(levels, F.lit(0).cast("bigint"), lambda n, v: n + F.when(v["level"] == at, v["n"]).otherwise(0))
        return F.struct(n.alias("n"), F.lit(at).alias("level"))

    sums = F.array(*[reached(at) for at in range(LEVELS)])
    vote = F.array_max(F.filter(sums, lambda s: s["n"] > 0))["level"]
    return F.when((F.size(told) > 0) & (F.size(known) > 0), vote).otherwise(ABSTAIN)


def candidate_votes(left: DataFrame, right: DataFrame) -> DataFrame:
    """unit, entity and a vote per field. left has unit, field, value, n; right has entity, field, value.
    A pair's votes are taken within its row."""
    pairs = blocked_pairs(blocking_keys(left, "unit"), blocking_keys(right, "entity"))
    known = stored(_by_field(right, "entity", F.col("value"), tuple(f for f in FIELDS if f != "isin")))
    met = pairs.join(_by_field(left, "unit", F.struct("value", "n"), FIELDS), "unit").join(known, "entity")
    # through explode, as the filter would else be pushed down and vote again
    votes = met.select("unit", "entity", F.explode(F.array(F.struct(*[_vote(f).alias(f"v_{f}") for f in FIELDS]))).alias("v")).select("unit", "entity", "v.*")
    # candidates of which nothing can be compared are none
    return votes.where(" or ".join(f"v_{f} <> {ABSTAIN}" for f in FIELDS))


class LabelModel:
    """Two hidden classes; given the class, blocks of matchers vote independently of each other.

    Fitted by expectation and maximisation over the vote patterns. Which matchers depend on each other
    is learned too: the pair whose joint table raises the likelihood most, beyond what its additional
    parameters are worth (by the Bayesian information criterion), becomes one block, and again until
    no pair does.
    """

    def __init__(self, smooth: float = 0.5, rounds: int = 200) -> None:
        self.smooth, self.rounds = smooth, rounds

    def _fit(self, blocks: list[list[int]]) -> tuple[np.ndarray, float]:
        """The posterior of every pattern, and the information criterion (the higher the better)."""
        codes = [np.unique(self.votes[:, block], axis=0, return_inverse=True)[1].ravel() for block in blocks]
        post = self.start
        for _ in range(self.rounds):
            weight = np.stack([self.n * (1 - post), self.n * post])
            score = np.log((weight.sum(1) + 1) / (weight.sum() + 2))[:, None] + np.zeros((2, len(self.n)))
            for code in codes:
                table = np.stack([np.bincount(code, w, code.max() + 1) for w in weight]) + self.smooth
                score += np.log(table / table.sum(1, keepdims=True))[:, code]
            new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
            done, post = np.abs(new - post).max() < 1e-6, new
            if done:
                break
        likelihood = float((self.n * np.logaddexp(score[0], score[1])).sum())
        parameters = sum(2 * int(code.max()) for code in codes)
        return post, likelihood - parameters * np.log(self.n.sum()) / 2

    def fit(self, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The posterior of every vote pattern, seen n times."""
        self.votes, self.n = votes, n.astype(float)
        self.start = np.where((votes >= 2).sum(1) > (votes == 0).sum(1), 0.9, 0.1)
        self.blocks = [[i] for i in range(votes.shape[1])]
        post, best = self._fit(self.blocks)
        while True:
            single = [b[0] for b in self.blocks if len(b) == 1]
            tries = [[b for b in self.blocks if b not in ([x], [y])] + [[x, y]] for x, y in itertools.combinations(single, 2)]
            fits = [(self._fit(blocks), blocks) for blocks in tries]
            (joint, value), blocks = max(fits, key=lambda f: f[0][1], default=((post, best), self.blocks))
            if value <= best:
                return post
            post, best, self.blocks = joint, value, blocks


def link_entities(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """unit, entity, confidence: the best entity of every unit that has one with confidence >= least.

    left has unit, cusip, ticker, isin, company_name and any number of rows per unit; right has entity,
    ncusip, ticker, comnam and any number per entity. Null, blank and N/A values abstain; a null unit or
    entity is no party. Ties go to the greater agreement, then the smaller entity. An empty side gives
    no rows; other columns are left out.
    """
    spark = left.sparkSession
    own = identity_fields(F.col("cusip"), F.col("ticker"), F.col("isin"), F.col("company_name"))
    theirs = identity_fields(F.col("ncusip"), F.col("ticker"), None, F.col("comnam"))
    told = left.where("unit is not null").select("unit", F.inline(F.array(*own))).where("value is not null")
    told = stored(told.groupBy("unit", "field", "value").agg(F.count("*").alias("n")))
    known = stored(right.where("entity is not null").select("entity", F.inline(F.array(*theirs))).where("value is not null").distinct())
    votes = stored(candidate_votes(told, known))
    columns = [f"v_{f}" for f in FIELDS]
    patterns = votes.groupBy(*columns).count().orderBy(*columns).collect()  # at most (LEVELS + 1) ^ len(FIELDS) rows
    if not patterns:
        return votes.select("unit", "entity", F.lit(0.0).alias("confidence")).where("false")
    table = np.array([[row[c] for c in columns] for row in patterns])
    post = LabelModel().fit(table, np.array([row["count"] for row in patterns]))
    learned = spark.createDataFrame([(*map(int, t), float(p)) for t, p in zip(table, post, strict=True)], ", ".join(f"{c} int" for c in columns) + ", confidence double")
    scored = votes.join(F.broadcast(learned), columns).where(F.col("confidence") >= least)
    agreement = sum((F.col(c) for c in columns), F.lit(0))
    best = Window.partitionBy("unit").orderBy(F.desc("confidence"), F.desc(agreement), "entity")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("unit", "entity", "confidence")
