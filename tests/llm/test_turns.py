import random

import numpy as np

from pyspark.sql import functions as F

from tidemark.llm.turns import repaired, speaker_turns


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "event_id string, section string, text string, n int, speaker string")
    df = df.withColumns({s: F.when(F.col("section") == s, F.col("text")) for s in ("a", "b")})
    got = speaker_turns(df, "event_id", {"a": "a", "b": "b"}, **options).orderBy("event_id", "section", "turn_no").collect()
    return got


def turns(spark, text, other="", **options):
    return [(r.speaker, r.n_words) for r in run(spark, [("e", "a", text, 1, "x"), ("e", "b", other, 1, "x")], **options) if r.section == "a"]


def test_layouts(spark):
    said = [("operator", 2), ("bórea quendahl", 3), ("lunette grialdi", 2), ("unidentified", 1)]
    assert turns(spark, "<Operator> Good day.\n<Bórea Quendahl - Quellmark Research - Analyst> How are\nyou?\n<Grialdi, Lunette> Fine, thanks.\n<Unidentified Participant> Ok.") == said
    assert turns(spark, "[1] Operator: (00:12) Good day. [2] Bórea  Quendahl (Analyst): How are you? [3] Lunette Grialdi, CFO: Fine, thanks. [4] Unknown Speaker: Ok.") == said
    assert turns(spark, "operator  [1]\nGood day.\n\nBórea Quendahl, Analyst  [2]\nHow are you?\nLUNETTE GRIALDI  [3]\nFine, thanks.\nUNIDENTIFIED ANALYST  [4]\nOk.") == said
    assert turns(spark, "[0:02:59.623] Conference Operator: Good day.\n>> Bórea Quendahl: How are you?\n(02:23) Lunette Grialdi -- [00:03:00] Fine, thanks.\nUnknown Speaker -- Ok.") == said


def test_short_labels_take_the_fullest_name_of_the_event(spark):
    text = "GRIALDI: One.\nL. Grialdi: two.\nOperator: Three.\nGrialdi, Lunette: four.\nP. Other: five."
    assert turns(spark, text, "Lunette Grialdi, COO: [laughter]") == [("lunette grialdi", 2), ("operator", 1), ("lunette grialdi", 1), ("p. other", 1)]


def test_only_spoken_words_count(spark):
    text = (
        "Ann Bee: Um, revenue (net of uhh, returns) [music] was $5 -- at the 10:30 session. (00:22) {pause} *coughs* <inaudible> That is a good question: er... yes.\n"
        "Operator: (applause)\nAnn Bee: Hmm. And on.\nSee Dee: uh..."
    )
    assert turns(spark, text) == [("ann bee", 19 - 3 + 2)]


def test_whatever_is_given(spark):
    assert run(spark, []) == []
    rows = [(None, "a", "Ann Bee: x", 1, ""), ("e", None, "Ann Bee: x", 1, ""), ("e", "a", None, 1, ""), ("f", "a", "", 1, ""), ("g", "a", "no label at all\r\nmore", 1, "")]
    assert [(r.event_id, r.speaker, r.n_words) for r in run(spark, rows)] == [("g", "unidentified", 5)]
    # copies count once, of several texts the longest
    rows = [("e", "a", "Ann Bee: one", 1, "")] * 3 + [("e", "a", "Ann Bee: one two three", 2, "")]
    assert [(r.turn_no, r.n_words) for r in run(spark, rows)] == [(1, 3)]
    long = "Ann Bee: " + "word " * 100_000
    assert turns(spark, long) == [("ann bee", 100_000)]


def test_utterances_and_intervals(spark):
    text = "[00:00:10] Ann Bee: one um two\n[00:00:30] Operator: three\n[00:00:20] Ann Bee: four\n[00:00:40] Operator: five"
    got = run(spark, [("e", "a", text, 1, "")])
    assert [r.utterance for r in got] == ["one two", "three", "four", "five"]
    assert [r.start_s for r in got] == [10, 25, 25, 40] and [r.end_s for r in got] == [25, 25, 40, 40]


def test_clock_resets_begin_segments():
    fixed, segment = repaired([0, 50, 45, 100, 5, 30, 60], 30)
    assert list(fixed) == [0, 47.5, 47.5, 100, 100, 125, 155] and list(segment) == [0, 0, 0, 0, 1, 1, 1]
    # one low stamp is an error, not a reset
    assert list(repaired([0, 100, 10, 110], 30)[0]) == [0, 55, 55, 110]
    assert len(repaired([], 30)[0]) == 0


def monotone(values):
    """The least-squares monotone fit by its max-min formula."""
    n = len(values)
    return [max(min(np.mean(values[j : k + 1]) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]


def test_intervals_equal_a_plain_repair(spark):
    """Texts with planted resets, single bad stamps and missing stamps; each piece its own turn."""
    rng, rows, expected = random.Random(4), [], {}
    for e in range(30):
        stamps, files = [], []
        for _ in range(rng.randrange(1, 4)):
            at, own = 0, []
            for _ in range(rng.randrange(6, 12)):
                at += rng.randrange(40, 90)
                own.append(at)
            for i in range(1, len(own) - 3, 4):
                if rng.random() < 0.5:  # a bad stamp: later than the next, or a good deal earlier than the last
                    own[i] += rng.choice([100, -70]) if i > 1 else 100
            files.append(own)
        base, fits = 0.0, []
        for number, own in enumerate(files):
            fit = monotone(own)
            shift = max(0.0, base - fit[0]) if number else 0.0
            fits += [f + shift for f in fit]
            base, stamps = fits[-1], stamps + own
        text, begins, now, at = "", [], None, 0
        while at < len(stamps):
            if rng.random() < 0.25:  # no stamp: begins where the last stamp was
                begins.append(now)
                lead = ""
            else:
                begins.append(fits[at])
                now, lead = fits[at], f"[{stamps[at] // 3600:02}:{stamps[at] // 60 % 60:02}:{stamps[at] % 60:02}] "
                at += 1
            middle = ""
            if at < len(stamps) and rng.random() < 0.2:  # in the middle of what is said
                now, middle = fits[at], f" ({stamps[at] // 3600:02}:{stamps[at] // 60 % 60:02}:{stamps[at] % 60:02}) and"
                at += 1
            text += f"{lead}{'Ann Bee' if len(begins) % 2 else 'See Dee'}: word{middle} on\n"
        expected[f"e{e:02}"] = [None if b is None else round(float(b), 6) for b in begins]
        rows.append((f"e{e:02}", "a", text, 1, ""))
    got = {}
    for r in run(spark, rows):
        got.setdefault(r.event_id, []).append(None if r.start_s is None else round(r.start_s, 6))
    assert got == expected


def test_one_event_with_most_of_the_rows(spark):
    long = "Ann Bee: " + "all of it " * 50
    rows = [("hot", "a", long, 1, ""), ("hot", "b", "Bee: yes", 1, "")] * 200 + [("hot", "a", f"Ann Bee: version {i}", 1, "") for i in range(200)]
    assert [(r.section, r.speaker, r.n_words) for r in run(spark, rows)] == [("a", "ann bee", 150), ("b", "ann bee", 1)]
