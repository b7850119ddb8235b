"""Speech transcripts into clean speaker turns.

An event's texts meet in one combining aggregate that keeps the longest of each section, so that only
these are shuffled, once. All that follows stays within the event's row. Each text is cut into
labelled pieces with built-in functions; utterances are cleaned of stamps, sound notes and
hesitations there too. Labels, word counts and stamps then go, without the texts, through a small
function that

* repairs the recording's clock: the stamps of a text are cut into file segments where the clock is
  reset, made monotone within each by isotonic regression, and the segments laid end to end;
* gives each piece its canonical person: a label with a first and a last name names the person for
  every shorter label of the same event;
* puts the pieces into the order of (segment, repaired clock, place in the text), drops those in which
  nothing is said, and merges pieces of one speaker that follow each other into one interval.

The fit is monotone in the order of the text, so the clock decides a turn's interval but moves no piece.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECE, _FIELD = "\u0001", "\u0002"

_NOTES = (
    "inaudible|indiscernible|unintelligible|laughter|laughs?|laughing|music|applause|cross-?talk|technical difficult(?:y|ies)"
    "|phone (?:rings?|ringing)|coughs?|coughing|sneezes?|pause|silence|(?:background )?noise|static|audio (?:gap|break|trouble|problems?)"
)
_CLOCK = r"(?:\[\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\]|\(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\)|\d{1,2}:\d{2}:\d{2}(?:\.\d+)?)"
#: Whatever may be a clock stamp, found in a third of the time.
_LIKE_CLOCK = r"[\[(]?\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?[\])]?"
_WORD = r"\p{L}[\p{L}'’\-]+"
_GAP = r"[ \t]{1,4}"
_ROLE = (
    r"(?:Analyst|C[EFOT]O|[^\n:<>()\[\]]{0,30}(?:President|Officer|Chair\w*|Director|Treasurer|Relations|Partner|Head of [\p{L} ]+)[\p{L} ,]{0,30})"
)
_PERSON = rf"(?:\p{{Lu}}[\p{{L}}'’\-]+{_GAP}\p{{Lu}}[\p{{L}}'’\-]+|\p{{Ll}}[\p{{Ll}}'’\-]+{_GAP}\p{{Ll}}[\p{{Ll}}'’\-]+|\p{{L}}\.{_GAP}{_WORD}|{_WORD},{_GAP}{_WORD}|{_WORD})"
_NOBODY = rf"(?:(?i:unidentified|unknown|unnamed){_GAP}{_WORD})"
_HOST = rf"(?:(?i:(?:conference{_GAP})?operator))"
_LABEL = rf"(?:{_HOST}|{_NOBODY}|(?!(?i:question|answer|note)\b){_PERSON}(?:,{_GAP}{_ROLE}|{_GAP}\((?i:{_ROLE})\)|{_GAP}-{_GAP}[^\n:<>\[\]]{{2,90}})?)"
#: Both branches begin with what a character either is or is not: most characters are passed over at once.
_START = (
    rf"(?m)^[ \t]*((?:>>[ ]*|\[\d{{1,4}}\][ ]+|{_CLOCK}[ ]*)*)"
    rf"(?:<(?!(?i:{_NOTES})>)({_LABEL})>|({_LABEL})(?::(?=\s|\z)|{_GAP}--(?=\s|\z)|{_GAP}\[\d{{1,4}}\][ \t]*$))"
    rf"|\[(?<=\s\[)\d{{1,4}}\][ ]((?:{_CLOCK}[ ]*)?)({_LABEL}):(?=\s|\z)"
)
_SIGN = r"[a-zA-Z0-9\p{L}\p{N}]"
#: A first letter of its own, and how each goes on.
_HUM = (
    rf"[uUeEaAhH](?<!{_SIGN}.)(?:(?<=[uU])[uU]*(?:[hH]+[mM]*|[mM]+)|(?<=[eE])[eE]*(?:[rR]+[mM]*|[hH]+)|(?<=[aA])[aA]*[hH]+|(?<=[hH])[hH]*[mM]+)(?!{_SIGN})"
)
_BRACKETS = rf"[\[(<{{*](?:\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:\.\d+)?)?|\s*(?i:{_NOTES})\s*)[\])>}}*]"
_BARE_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:\.\d+)?"
_SPACES = r"[^\n -~](?<=[\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])"

_TURN = "section int, turn_no bigint, speaker string, n_words bigint, start_s double, end_s double, pieces array<int>"


def repaired(stamps: Sequence[float], gap: float) -> tuple[np.ndarray, np.ndarray]:
    """The stamps of one text, repaired, and the segment of each.

    A segment ends where a stamp, and the next one, lie more than gap before the last; a single low
    stamp is an error of its own. Within a segment the stamps become their least-squares monotone
    fit; each segment starts where the one before ended.
    """
    values, cuts = list(stamps), [0]
    for i in range(1, len(values)):
        following = values[min(i + 1, len(values) - 1)]
        if values[i] < values[i - 1] - gap and following < values[i - 1] - gap and i - cuts[-1] > 1:
            cuts.append(i)
    out, segment, base = np.empty(len(values)), np.zeros(len(values), int), 0.0
    for number, (start, end) in enumerate(zip(cuts, [*cuts[1:], len(values)], strict=True)):
        blocks: list[list[float]] = []
        for v in values[start:end]:
            blocks.append([v, 1])
            while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
                (a, n), (b, m) = blocks[-2:]
                blocks[-2:] = [[(a * n + b * m) / (n + m), n + m]]
        fit = np.repeat([b[0] for b in blocks], [int(b[1]) for b in blocks])
        out[start:end] = fit + (max(0.0, base - fit[0]) if number and len(fit) else 0.0)
        segment[start:end] = number
        base = out[end - 1] if end else 0.0
    return out, segment


def canonical(names: list[str]) -> list[str]:
    """The fullest name that the labels of an event, in order, have for each person.

    A short label that fits several persons means the one who spoke last, else the next to speak."""
    parts = [(n.split(" ", 1)[0] if " " in n else None, n.rsplit(" ", 1)[-1]) for n in names]
    full = [f if f and len(f.replace(".", "")) > 1 else None for f, _ in parts]
    guess: list[list[str | None]] = [[], []]
    for way, backward in zip(guess, (False, True), strict=True):
        heard: dict[tuple, str] = {}
        for i in range(len(parts) - 1, -1, -1) if backward else range(len(parts)):
            first, last = parts[i]
            if full[i]:
                heard[last,] = heard[last, first[0]] = full[i]
            way.append(heard.get((last, first[0]) if first else (last,)))
    initials = {last: first for first, last in parts if first}
    out = []
    for (first, last), own, before, after in zip(parts, full, guess[0], reversed(guess[1]), strict=True):
        first = own or before or after or first or initials.get(last)
        out.append(f"{first} {last}" if first else last)
    return out


def piece_clocks(counts: Sequence[int], leads: Sequence[bool], stamps: Sequence[float], gap: float) -> list[tuple[int, float | None, float | None]]:
    """(segment, when the piece begins, its last stamp) of every piece of a text, of which counts gives the
    number of stamps. A piece that doesn't begin with a stamp begins at the last stamp before it."""
    if not len(stamps):
        return [(0, None, None)] * len(counts)
    fits, segments = (x.tolist() for x in repaired(stamps, gap))
    out, at, number, now = [], 0, 0, None
    for n, lead in zip(counts, leads, strict=True):
        if not n:
            out.append((number, now, None))
            continue
        begin, number = (fits[at], segments[at]) if lead else (now, number)
        now = fits[at + n - 1]
        out.append((number, begin, now))
        at, number = at + n, segments[at + n - 1]
    return out


def merged(sections: list[list[tuple[str, int, int, float | None, float | None]]]) -> list[tuple]:
    """The turns of an event. Each section is a list of (name, words, segment, begin, last stamp)."""
    people = iter(canonical([p[0] for pieces in sections for p in pieces if p[0] not in ("operator", "unidentified")]))
    turns = []
    for number, pieces in enumerate(sections):
        who = [p[0] if p[0] in ("operator", "unidentified") else next(people) for p in pieces]
        order = sorted((p[2], p[3] if p[3] is not None else -1.0, i) for i, p in enumerate(pieces) if p[1] > 0)
        own: list[list] = []
        for _, _, i in order:
            words, begin, last = pieces[i][1], pieces[i][3], pieces[i][4]
            if own and begin is not None:
                own[-1][5] = begin if own[-1][5] is None else max(own[-1][5], begin)
            if not own or own[-1][2] != who[i]:
                own.append([number, len(own) + 1, who[i], 0, begin, begin, []])
            own[-1][3] += words
            own[-1][5] = last if own[-1][5] is None else own[-1][5] if last is None else max(own[-1][5], last)
            own[-1][6].append(i)
        turns += own
    return turns


def _turns(gap: float, n_sections: int):
    @F.arrow_udf(f"array<struct<{_TURN.replace(' ', ':').replace(',:', ',')}>>")
    def turns(*columns: pa.Array) -> pa.Array:
        ends = lambda lengths: [0, *np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False)).tolist()]
        flat = []
        for names, words, stamps, leads in zip(*[iter(columns)] * 4, strict=True):
            each = stamps.flatten()
            counts = each.value_lengths().fill_null(0)
            flat.append((ends(names.value_lengths()), names.flatten().to_pylist(), words.flatten().to_pylist(), leads.flatten().to_pylist(), counts.to_pylist(), ends(counts), each.flatten().to_pylist()))
        offsets, found = [0], []
        for row in range(len(columns[0])):
            sections = []
            for at, names, words, leads, counts, stamp_at, stamps in flat:
                a, b = at[row], at[row + 1]
                clocks = piece_clocks(counts[a:b], leads[a:b], stamps[stamp_at[a] : stamp_at[b]], gap)
                sections.append([(n, w, *c) for n, w, c in zip(names[a:b], words[a:b], clocks, strict=True)])
            found += merged(sections)
            offsets.append(len(found))
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
        fields = [pa.array([t[i] for t in found], kind) for i, kind in enumerate(kinds)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, [f.split()[0] for f in _TURN.split(", ")]))

    return turns


def _seconds(stamp: Column) -> Column:
    parts = F.split(F.regexp_replace(stamp, r"[\[\]()]", ""), ":")
    return F.aggregate(parts, F.lit(0.0), lambda seconds, x: seconds * 60 + x.cast("double"))


def spoken(utterance: Column) -> Column:
    """The words of an utterance, one space apart, without clock stamps, notes of sounds or audio
    trouble, hesitation noises, and whatever between white space holds no letter or digit.

    A pattern whose first character is rare passes over a text several times as fast as one with many
    ways to begin: hence one pattern for each kind."""
    said = F.regexp_replace(utterance, _BRACKETS, " ")
    said = F.when(utterance.contains(":"), F.regexp_replace(said, _BARE_CLOCK, " ")).otherwise(said)
    said = F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(said, _HUM, " ")), r"\s[^a-zA-Z0-9\p{L}\p{N}\s]++(?!\S)", " ")
    return F.trim(F.regexp_replace(said, r"\s+", " "))


def word_number(said: Column) -> Column:
    """How many words the result of spoken has."""
    return F.when(said == "", 0).otherwise(F.octet_length(said) - F.octet_length(F.replace(said, F.lit(" "), F.lit(""))) + 1)


def _name(label: Column) -> Column:
    """A label in lower case without its role."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(label, r"\s+", " ")), rf" (?:- .*|\(.*\))$|, (?:{_ROLE})$", ""))


def _person(name: Column) -> Column:
    """first and last name, operator, or unidentified."""
    return (
        F.when(name.rlike("^(?:conference )?operator$"), "operator")
        .when((name == "") | name.rlike("^(?:unidentified|unknown|unnamed) "), "unidentified")
        .when(name.contains(","), F.regexp_replace(name, r"^([^, ]+), ([^, ]+)$", "$2 $1"))
        .otherwise(name)
    )


def with_pieces(df: DataFrame, text: str, into: str) -> DataFrame:
    """df plus the arrays {into}_names, _said, _words, _stamps, _leads: an entry for every piece of the text."""
    plain = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("\n")), _SPACES, " ")
    # what stands before the first label is said by nobody known
    marked = F.concat(F.lit(_FIELD * 2), F.regexp_replace(plain, _START, f"{_PIECE}$1$4{_FIELD}$2$3$5{_FIELD}"))
    pieces, said, name = (F.col(f"{into}_{c}") for c in ("pieces", "said", "name"))
    # few pieces hold a colon, and only those may hold a stamp
    found = lambda p: F.filter(F.regexp_extract_all(p, F.lit(_LIKE_CLOCK), F.lit(0)), lambda c: c.rlike(f"^{_CLOCK}$"))
    stamps = lambda p: F.when(p.contains(":"), F.transform(found(p), _seconds))
    leads = lambda p: F.when(p.contains(":"), p.rlike(rf"^(?:[^{_FIELD}]*{_CLOCK}|[^{_FIELD}]*{_FIELD}[^{_FIELD}]*{_FIELD}\s*{_CLOCK})"))
    # in steps, so that nothing is computed twice
    df = df.withColumn(f"{into}_pieces", F.split(marked, _PIECE))
    df = df.withColumns({f"{into}_said": F.transform(pieces, lambda p: spoken(F.substring_index(p, _FIELD, -1))), f"{into}_name": F.transform(pieces, lambda p: _name(F.substring_index(F.substring_index(p, _FIELD, 2), _FIELD, -1)))})
    return df.withColumns(
        {
            f"{into}_names": F.transform(name, _person),
            f"{into}_words": F.transform(said, word_number),
            f"{into}_stamps": F.transform(pieces, stamps),
            f"{into}_leads": F.transform(pieces, leads),
        }
    ).drop(f"{into}_pieces", f"{into}_name")


def speaker_turns(calls: DataFrame, event: str, sections: Mapping[str, str], gap: float = 30.0) -> DataFrame:
    """One row per turn: event, section, turn_no, speaker, n_words, start_s, end_s, utterance.

    sections gives the text column of every section. If an event has several texts for a section the
    longest counts (of equally long ones any, but always the same). speaker is `first last` in lower
    case by the fullest label the event has for the person, `operator`, or `unidentified` (also for
    words before the first label). start_s and end_s are seconds of the repaired clock, null before the
    first stamp: a turn begins at its own stamp, or at the last one before it, and ends at the latest of
    its stamps and the beginning of the next turn. Null events, and null or empty texts, give no
    rows; very long texts are processed whole; other columns are left out. The texts of an event must
    fit into a row, as they do in the table.
    """
    version = lambda c: F.struct(F.length(c).alias("length"), F.xxhash64(c).alias("hash"), F.col(c).alias("text"))
    longest = [F.max(F.when(F.length(c) > 0, version(c))).getField("text").alias(f"t{i}") for i, c in enumerate(sections.values())]
    rows = calls.where(F.col(event).isNotNull()).groupBy(event).agg(*longest)
    for i in range(len(sections)):
        rows = with_pieces(rows, f"t{i}", f"s{i}").drop(f"t{i}")
    told = [f"s{i}_{part}" for i in range(len(sections)) for part in ("names", "words", "stamps", "leads")]
    rows = rows.withColumn("turn", F.explode(_turns(gap, len(sections))(*told)))
    said = F.coalesce(*[F.when(F.col("turn.section") == i, F.col(f"s{i}_said")) for i in range(len(sections))])
    names = F.array(*map(F.lit, sections))
    return rows.select(
        event,
        names[F.col("turn.section")].alias("section"),
        *[f"turn.{c}" for c in ("turn_no", "speaker", "n_words", "start_s", "end_s")],
        F.array_join(F.transform("turn.pieces", lambda i: said[i]), " ").alias("utterance"),
    )
