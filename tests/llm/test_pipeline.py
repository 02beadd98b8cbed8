import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from oracle import SF, connection
from sprocket.llm import mixing, packing, pii, queries
from sprocket.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(sets, percent):
    """The first member of each set's component, by brute force over all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def test_each_stage_by_brute_force(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    source = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    docs = source
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "stage")
        assert docs.columns == source.columns, name
        kept.append(docs.orderBy("doc_id").collect())
    rules, single, clean, mixed = kept

    # 1: the rules' SQL
    want = {r[0] for r in connection().sql(f"SELECT doc_id FROM ({queries.oracle_sql()['op10_quality']}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in rules} == want and len(rules) == len(want)
    texts = {r["doc_id"]: r["text"] for r in source.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in rules)

    # 2: all pairs
    sets = []
    for r in rules:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    first = groups(sets, 80)
    assert [r["doc_id"] for r in single] == [r["doc_id"] for i, r in enumerate(rules) if first[i] == i] and len(single) < len(rules)

    # 3: spans replaced one by one, and none of the base patterns left
    before = {r["doc_id"]: r["text"] for r in single}
    assert [r["doc_id"] for r in clean] == sorted(before)
    found = 0
    for r in clean:
        text, spans = before[r["doc_id"]], pii.all_spans(before[r["doc_id"]], pii.trained())
        found += len(spans)
        if all(a[2] <= b[0] for a, b in zip(spans, spans[1:])):
            for s, k, e in reversed(spans):
                text = f"{text[:s]}<{pii.KINDS[k].upper()}>{text[e:]}"
            assert r["text"] == text
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    assert found

    # 4: quotas of the sources, and every text a run of words of its document
    sizes, taken, whole = {}, {}, {r["doc_id"]: r for r in clean}
    for r in clean:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"]))
    each = {}
    for r in mixed:
        n = len(WORD.findall(r["text"]))
        taken[r["source"]] = taken.get(r["source"], 0) + n
        each[r["doc_id"]] = each.get(r["doc_id"], 0) + n
        assert r["text"] in whole[r["doc_id"]]["text"] and r["n_chars"] == len(r["text"])
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    for s, t in zip(names, mixing.targets([sizes[s] for s in names], share=Fraction(3, 2)), strict=True):
        assert abs(taken.get(s, 0) - t) <= 2 * P.MIX_BLOCK
    assert all(n <= 2 * len(WORD.findall(whole[i]["text"])) for i, n in each.items())

    # 5: the ids of all pieces, and gapless sequences
    pieces = P.STAGES[-1][1](spark, docs, SF).toPandas()
    tok = Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))
    lengths = sorted(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)
    assert pieces.length.sum() == sum(lengths)
    assert sorted(pieces[pieces.start == 0].doc_tokens) == lengths
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.values == np.concatenate(([0], g.length.cumsum().values[:-1]))).all() and g.length.sum() <= 1024
    once = {i: t for i, t in ((r["doc_id"], r["text"]) for r in mixed) if sum(x["doc_id"] == i for x in mixed) == 1}
    for i, t in once.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for p in pieces[pieces.doc_id == i].itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())


def test_repeated_ids_keep_one_of_each_group(spark):
    import corpus_pipeline as P

    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text here"), (None, "a b c d e f"), (None, "")]
    out = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r["text"] for r in out.collect()) == ["", "a b c d e f", "quite another text here"]


def test_stages_on_odd_tables(spark):
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, extra int"
    for rows in ([], [(1, None, None, None, 1), (None, "", "en", "a", 2), (3, "one word " * 80, None, "b", None)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in P.STAGES[:-1]:
            docs = written(stage(spark, docs, SF), "stage")
            assert docs.columns == ["doc_id", "text", "lang", "source", "extra"], name
        assert P.STAGES[-1][1](spark, docs, SF).count() >= 0
