"""The audit of five filters against a plain count, order by order."""

import itertools
import re

from helpers import EDGE, WORD, edge, empty, frame, sorted_rows

from vocale.llm import filter_audit
from vocale.llm.filter_audit import audit, copies, failures

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(rows, at):
    doc_id, text, _, _ = rows[at]
    text = text or ""
    words = WORD.findall(text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        out.add("C")
    if set("#$%&*|") & set(text):
        out.add("D")
    if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows):
        out.add("E")
    return out


def brute(rows, good, bad):
    fails = [failing(rows, i) for i in range(len(rows))]
    out = []
    for part in {s or "" for *_, s in rows}:
        mine = [i for i, (*_, s) in enumerate(rows) if (s or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, name in enumerate(order, 1):
                gone = [i for i in left if name in fails[i]]
                redundant = sum(name in fails[i] for i in mine if i not in left)
                left = [i for i in left if name not in fails[i]]
                total[name] += len(gone)
                lines.append((name, (
                    part, "".join(order), step, len(left), len(gone), redundant, sum(fails[i] == {name} for i in mine),
                    sum(rows[i][0] in good for i in gone), sum(rows[i][0] in bad for i in gone))))
        out += [(*line, total[name]) for name, line in lines]
    return sorted(out, key=repr)


def labels(spark, good, bad):
    rows = [(i, 1, None) for i in good] + [(i, 0, 1) for i in bad] + [(None, 1, 1), (7, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def check(spark, rows, good, bad):
    got = audit(frame(spark, rows), labels(spark, good, bad)).select(*COLUMNS)
    assert sorted_rows(got) == brute(rows, good, bad)


def test_awkward_rows(spark):
    check(spark, EDGE, {1, 8, 10}, {8, 5})


def test_all_combinations(spark):
    """Texts that fail each set of A to D, some twice, so that E comes on top; one doc_id for two texts."""
    rows = []
    for k, chosen in enumerate(itertools.chain.from_iterable(itertools.combinations("ABCD", n) for n in range(5))):
        words = ["w"] * 100 if "B" in chosen else [f"w{i}" for i in range(60)]
        words = words[:20] if "A" in chosen else words
        text = " ".join(words) + (" " + "X" * 200 if "C" in chosen else "") + ("%" if "D" in chosen else "")
        rows += [(100 + k, text, "en", "a"), (200 + k, text, "en", "b" if k % 2 else None), (300, text, "fr", "a")]
    check(spark, rows, {100, 203, 300}, {300, 101})


def test_a_hot_text_is_spread(spark, monkeypatch):
    rows = [(i, "same text again" if i % 3 else f"text {i}", "en", "a") for i in range(3000)]
    docs = frame(spark, rows, extra=False)
    marks = docs.selectExpr("doc_id", "source AS part", "xxhash64(text) AS hash", "text")
    for limit in (1_000_000, 0):  # with and without the broadcast of the shared hashes
        found = copies(marks, marks.select("doc_id", "hash"), keys_limit=limit)
        assert sorted(r["doc_id"] for r in found.collect()) == [i for i in range(2, 3000) if i % 3]
    # Equal hashes with different texts are no copies.
    same = marks.selectExpr("doc_id", "part", "1L AS hash", "text")
    assert copies(same, same.select("doc_id", "hash")).count() == 1999


def test_empty_table(spark):
    assert audit(empty(spark), labels(spark, {1}, {2})).count() == 0
    assert failures(empty(spark)).columns == ["doc_id", "part", "bits", "n"]


def test_extra_columns(spark):
    clash = edge(spark).selectExpr("*", "1 AS bits", "2 AS n", "'x' AS part", "3 AS hash", "4 AS least", "5 AS shares")
    assert sorted_rows(audit(clash, labels(spark, {1}, {8})).select(*COLUMNS)) == brute(EDGE, {1}, {8})
    assert filter_audit.FILTERS == "ABCDE"
