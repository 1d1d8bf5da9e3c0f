from itertools import combinations

import corpus_pipeline
from helpers import EDGE, WORD, edge, empty, frame
from oracle_check import connect, differences
from tokenizers import Tokenizer

from vocale.llm.common import vocabulary_path
from vocale.llm.quality import fit_quality, score_quality
from vocale.llm.queries import ORACLES, QUERIES
from vocale.llm.toxicity import fit_toxicity, score_toxicity

DATA = "/root/testdata/sf0.001"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def test_oracles(spark):
    con = connect(DATA)
    for name, sql in ORACLES.items():
        assert differences(QUERIES[name](spark, DATA).toPandas(), con.execute(sql).df()) == [], name


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
            assert out.count() <= docs.count()
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() == corpus_pipeline.run(spark, DATA).count()


def test_stages_stand_awkward_rows(spark):
    for rows in (edge(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, DATA).count() >= 0


def test_one_of_each_group_stays(spark):
    kept = corpus_pipeline.one_of_each(spark, edge(spark), DATA).collect()
    ids = [r["doc_id"] for r in kept]
    assert 1 in ids and 8 not in ids  # equal texts
    assert {2, 3, 4, 5, 6, 7, 9, 10} <= set(ids) and ids.count(None) == 2
    assert len(EDGE) - len(kept) == 2


def test_no_text_is_lost_under_a_shared_id(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [
        (1, text, "en", "a"), (8, text, "en", "a"), (8, "a text that is like nothing else in the table at all", "en", "a"),
        (2, "equal rows stay once whatever they say to us", "en", "a"), (2, "equal rows stay once whatever they say to us", "en", "a"),
        (9, "", "en", "a"), (9, None, "en", "a"), (9, "", "en", "a"), (None, text, "en", "a"), (None, text, "en", "a"),
    ]
    kept = corpus_pipeline.one_of_each(spark, frame(spark, rows), DATA)
    assert kept.columns == corpus_pipeline.COLUMNS
    want = [rows[0], rows[2], rows[3], rows[5], rows[6], rows[8], rows[9]]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted((r[:2] for r in want), key=repr)


def test_an_id_on_a_third_of_the_rows(spark):
    rows = [(i if i % 3 else 0, f"text {i} " + " ".join(f"w{i}x{k}" for k in range(9)), "en", "a") for i in range(600)]
    kept = corpus_pipeline.one_of_each(spark, frame(spark, rows, extra=False), DATA)
    assert sorted(r["text"] for r in kept.collect()) == sorted(r[1] for r in rows)


def lines_left(rows):
    """Texts without the lines that five documents share, in plain Python."""
    holders = {}
    for i, text in rows:
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    keep = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    return [(i, "\n".join(x for x in text.split("\n") if keep.get(key(x), i) == i)) for i, text in rows]


def first_of_classes(rows):
    """The smallest id of each class of texts that share three quarters of their shingles."""
    sets = {}
    for i, text in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[a]:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return [(i, text) for i, text in rows if top(i) == i]


def test_run_against_plain_python(spark):
    """The models' decisions are taken from their scores; all that follows is done again."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    toxic = score_toxicity(docs, fit_toxicity(docs, labels), corpus_pipeline.COLUMNS)
    assert toxic.filter("(score >= 0.3) != (predicted = 1)").count() == 0
    clean = docs.join(toxic.filter("score < 0.3").select("doc_id"), "doc_id")
    good = score_quality(clean, fit_quality(clean, labels), corpus_pipeline.COLUMNS).filter("score >= 0.3")
    rows = sorted((r["doc_id"], r["text"] or "") for r in good.collect())
    assert 100 < len(rows) < docs.count()
    left = dict(first_of_classes(lines_left(rows)))
    assert len(left) < len(rows)
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, DATA).collect():
        pieces.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"], r["piece"]))
    assert pieces.keys() == left.keys()
    for i, text in left.items():
        total = len(library.encode(text, add_special_tokens=False).ids)
        want = [(a, min(2048, total - a), k) for k, a in enumerate(range(0, max(total, 1), 2048))]
        assert sorted(pieces[i]) == want
