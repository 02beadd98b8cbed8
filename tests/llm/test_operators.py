import hashlib
import io
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import SF, same
from sprocket.llm import html, jaccard, langid, media, mixing, packing, pii, quality, queries, urllists, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (4, "one two", "en", "a", 7), (5, "x " * 30000, "en", None, 60000), (6, "ONE two\tthree four five six", None, "b", 1), (6, "ONE two\tthree four five six", None, "b", 1), (None, "é ü a@b.co 10.0.0.1", "fr", "c", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name])


def test_odd_rows(odd, none):
    run = {
        "pack": packing.pack,
        "pii": lambda d: pii.find(d, keep=["doc_id"]),
        "redact": pii.redact,
        "jaccard": jaccard.join,
        "langid": lambda d: langid.predict(d, langid.fit(d)),
        "mix": mixing.mix,
        "media": lambda d: media.media_table(d),
        "quality": quality.quality,
        "html": lambda d: html.main_text(d.select("doc_id", F.col("text").alias("html"))),
        "warc": lambda d: warc.read_chunks(warc.write_archive(d.withColumn("url", F.lit(None).cast("string")), "text", "doc_id")),
    }
    for name, f in run.items():
        assert f(none).count() == 0, name
        n = f(odd).count()
        assert n == len(ODD) or name == "pack", name


CLASHES = ["size", "source_size", "target", "passes", "chosen", "taken", "lang_pred", "score", "n_bytes", "feature", "tile", "kept", "n_words", "base_failed", "n_email", "spans", "component_id", "n_shingles", "sequence_id", "offset", "lists", "patterns", "blocked", "payload_bytes", "valid", "record", "chunk", "n"]


def test_clashing_columns(spark):
    plain = spark.createDataFrame([(1, "one two three four five", "en", "a"), (2, "one two three four five", "en", "a"), (3, None, "de", None)], "doc_id long, text string, lang string, source string")
    both = plain.select("*", *(F.lit("clash").alias(c) for c in CLASHES))
    events = spark.createDataFrame([("x.org", "l", "add", 1)], "pattern string, list string, action string, at long")

    def captures(d):
        return urllists.match(d.select("*", F.lit("http://x.org/").alias("url"), F.lit(5).alias("fetched_at")), events)

    for f in (
        packing.pack,
        pii.find,
        jaccard.join,
        lambda d: langid.predict(d, langid.fit(d), keep=tuple(c for c in d.columns if c != "text")),
        mixing.mix,
        lambda d: media.media_table(d, keep=tuple(c for c in d.columns if c != "text")),
        quality.quality,
        captures,
        lambda d: html.main_text(d.withColumnRenamed("text", "html")),
        lambda d: warc.read_chunks(warc.write_archive(d.withColumn("url", F.lit("http://x/")), "text", "doc_id")),
    ):
        want, got = f(plain), f(both)
        assert len(got.columns) == len(set(got.columns))
        own = want.columns
        assert sorted(map(repr, got.select(*own).collect())) == sorted(map(repr, want.collect()))


def test_odd_values(odd):
    q = {(r["doc_id"], r["n_words"]): r for r in quality.quality(odd).collect()}
    assert q[(1, 0)]["base_failed"] and q[(5, 30000)]["n_repeat_words"] == 30000 and q[(5, 30000)]["base_failed"]
    found = {r["doc_id"]: r for r in pii.find(odd, keep=["doc_id"]).collect()}
    assert found[1]["spans"] == found[2]["spans"] == "" and found[None]["spans"] == "email:4:10,ip:11:19"
    classes = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 3, 6)} <= classes
    m = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(odd).collect()}
    assert m[(1, 0)] == 0 and all(t <= 2 * n for (_, n), t in m.items())
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(odd)).filter("doc_id in (1, 2)").collect()} == {"und"}
    p = packing.pack(odd).toPandas()
    assert p[p.doc_id == 1].ids_crc32.tolist() == [zlib.crc32(bytes(4))] and p.length.sum() == p.drop_duplicates(["doc_id", "doc_tokens"]).doc_tokens.sum() + p[p.doc_id == 6].doc_tokens.iloc[0]
    t = {r["doc_id"]: r["text"] for r in html.main_text(odd.select("doc_id", F.col("text").alias("html"))).collect()}
    assert t[1] == t[2] == "" and t[3] == "one two"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_jaccard_brute(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", 2)
    monkeypatch.setattr(jaccard, "TILE", 3)
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = d.collect()
    base = rows[0]["text"]
    more = [(10_000 + i, " ".join(w for j, w in enumerate(base.split()) if j != 7 * i)) for i in range(12)]
    d = d.union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = d.collect()
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), r["doc_id"])
    want = sorted((r["doc_id"], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))
    assert sorted(map(tuple, jaccard.join(d).collect())) == want


def test_jaccard_sizes_at_80(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", 2)
    monkeypatch.setattr(jaccard, "TILE", 3)
    rows, sets = [], []
    for g, (few, many) in enumerate([(65, 81), (66, 82), (76, 95), (90, 112), (65, 78), (80, 96), (100, 118), (120, 150)] * 2):
        base = [f"g{g}w{i}" for i in range(many + 4)]
        texts = [base, base[: few + 4]]
        # near the shorter text only: they make the lists long and the leaders others
        texts += [[*base[: few - 2], *(f"g{g}v{v}x{i}" for i in range(6))] for v in range(12)]
        for w in texts:
            rows.append((len(rows), " ".join(w)))
            sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                a_, b_ = sorted((find(i), find(j)))
                root[b_] = a_
    want = [(i, len(s), find(i)) for i, s in enumerate(sets)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(d, k=5, percent=80).collect())) == want


def test_word_hashes_over_parts(monkeypatch):
    text = "alpha beta " * 60 + "y" * 400 + " gamma\tdelta\n" + "z " * 99
    whole = jaccard._word_hashes(text.encode())
    monkeypatch.setattr(jaccard, "PART", 128)
    parts = jaccard._word_hashes(text.encode())
    assert len(whole) == len(parts) == len(text.split())
    assert (whole == parts).all()
    for n in (127, 128, 129, 256, 1000):
        at_the_end, inside = jaccard._word_hashes(b"a " + b"q" * n), jaccard._word_hashes(b"a " + b"q" * n + b" b")
        assert (at_the_end == inside[:2]).all()


def test_jaccard_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SENT", 0)
    words_ = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words_)), (7, " ".join(words_[1:])), (5, " ".join(words_[2:])), (None, "other words than those here"), (9, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.join(d).collect()), key=repr)
    assert got == sorted([(None, 57, 5), (7, 56, 5), (5, 55, 5), (None, 2, None), (9, 0, 9)], key=repr)


def test_base_spans_brute():
    def brute(x):
        o = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
        o += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
        o += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))]
        o += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(o)

    rng = np.random.default_rng(5)
    for _ in range(20000):
        x = "".join(rng.choice(list("ab.@@1234 +-(_%25"), rng.integers(0, 40)))
        assert brute(x) == pii.base_spans(x)


def test_field_adds_spans():
    w = pii.trained()
    text = "write to jane.doe (at) example (dot) org today, version 4.0 of 2024"
    assert [text[s:e] for s, _, e in pii.all_spans(text, w)] == ["jane.doe (at) example (dot) org"]
    got = [pii.decode(t, w) == s for t, s in pii.examples(77, 200)]
    assert np.mean(got) > 0.9


def labellings(n, segs):
    """All labellings of n tokens: lists of (number in segs, kind)."""

    def of(at):
        if at == n:
            yield []
            return
        for rest in of(at + 1):
            yield rest
        for k, (i, j, _) in enumerate(segs):
            if i == at:
                for rest in of(j):
                    for y in range(len(pii.KINDS)):
                        yield [(k, y), *rest]

    return list(of(0))


def worth(n, segs, w, labelling):
    total, last, at = 0.0, pii.OUT, 0
    for k, y in labelling:
        i, j, f = segs[k]
        for _ in range(at, i):
            total += w.step[last, pii.OUT]
            last = pii.OUT
        total += w.step[last, y] + w.span[y, f].sum()
        at, last = j, y
    for _ in range(at, n):
        total += w.step[last, pii.OUT]
        last = pii.OUT
    return total


@pytest.mark.parametrize("text", ["tel 555-123-4567", "a 12 b", "x (at) y (dot) com 7", "+1 2 3", "12"])
def test_field_against_enumeration(text):
    rng = np.random.default_rng(3)
    tokens, segs = pii.lattice(text)
    segs = segs[:7]
    for w in (pii.trained(), pii.Weights(rng.normal(size=(4, pii.N_FEATURES)), rng.normal(size=(5, 5)))):
        all_ = labellings(len(tokens), segs)
        x = np.array([worth(len(tokens), segs, w, a) for a in all_])
        total, expect, steps = pii.sums(len(tokens), segs, w)
        assert np.isclose(total, np.logaddexp.reduce(x))
        p = np.exp(x - total)
        want = np.zeros_like(expect)
        for a, q in zip(all_, p, strict=True):
            for k, y in a:
                want[k, y] += q
        assert np.allclose(expect, want)
        assert np.isclose(steps.sum() - expect.sum(), sum(q * (len(tokens) - sum(segs[k][1] - segs[k][0] for k, _ in a)) for a, q in zip(all_, p, strict=True)))


@pytest.mark.parametrize("text", ["tel 555-123-4567 x", "a 12 b", "x (at) y (dot) com 7", "id +1 2", "12"])
def test_decoding_against_enumeration(text):
    rng = np.random.default_rng(4)
    tokens, segs = pii.lattice(text)
    for w in (pii.trained(), *(pii.Weights(rng.normal(size=(4, pii.N_FEATURES)), rng.normal(size=(5, 5))) for _ in range(3))):
        w.step[pii.OUT, pii.OUT] = 0.0
        if len(segs) < 12:
            number = {(tokens[i][0], tokens[j - 1][1]): k for k, (i, j, _) in enumerate(segs)}
            got = [(number[s, e], y) for s, y, e in pii.decode(text, w)]
            assert np.isclose(worth(len(tokens), segs, w, got), max(worth(len(tokens), segs, w, a) for a in labellings(len(tokens), segs)))


def test_field_on_sentences_of_another_hand():
    w = pii.trained()
    for text, spans in [
        ("Ring us on (020) 794-6095 or 555-987-6543 before noon.", ["(020) 794-6095", "555-987-6543"]),
        ("The server at 10 (dot) 0 (dot) 0 (dot) 7 went down on 2024-01-05 at 10:30.", ["10 (dot) 0 (dot) 0 (dot) 7"]),
        ("Reach bob[at]mail[dot]com, see page 12, room 44a and table 3.2", ["bob[at]mail[dot]com"]),
        ("Sold 1200 of 3500 units in 2019, up 4.5 percent", []),
        ("Zwischen 1914 und 1918 fielen 17 Millionen", []),
    ]:
        assert [text[s:e] for s, _, e in pii.all_spans(text, w)] == spans


def test_windows_end_with_lines():
    w = pii.trained()
    text = "call 555-987-6543\n" * 3 + "5\n" * 2000
    assert [text[s:e] for s, _, e in pii.all_spans(text, w)] == ["555-987-6543"] * 3


@pytest.mark.parametrize("address", ["billing.department (at) international-freight-and-logistics-partners (dot) com", "x" * 60 + " (at) example (dot) org", "jane.doe (at) " + "y" * 60 + " (dot) org"])
def test_field_reaches_whole_tokens(address):
    w = pii.trained()
    text = f"Please write to {address} today or tomorrow, whatever suits you"
    assert [text[s:e] for s, _, e in pii.all_spans(text, w)] == [address]


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9001, ""), (9002, " a  b "), (9003, None), (9004, "<|endoftext|>"), (9005, "hello  <|endoftext|> world<|endoftext|>"), (9006, "word " * 70_000)], "doc_id long, text string"))
    got = packing.pack(d).toPandas()
    ids = {r["doc_id"]: np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in d.collect()}
    for i, g in got.groupby("doc_id"):
        at = 0
        for p in g.sort_values("start").itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids[i]))
            assert zlib.crc32(ids[i][at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids[i])
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.values == np.concatenate(([0], g.length.cumsum().values[:-1]))).all()
        assert g.length.sum() <= 1024
    assert got.length.sum() / (got.sequence_id.nunique() * 1024) > 0.985
    assert set(ids) == set(got.doc_id)


def test_plan_cuts_equal_lengths():
    assert packing.plan({600: 5000}).sequences == -(-600 * 5000 // 1024)


def test_apportion():
    assert mixing.apportion([Fraction(100), Fraction(60), Fraction(33)], 10, [99] * 3) == [5, 3, 2]
    assert mixing.targets([10, 100, 5, 0]) == [20, Fraction(285, 2), 10, 0]
    assert sum(n for *_, n in mixing.shard_quotas({"a": 1000, "b": 500, None: 10})) == round(1510 * Fraction(3, 2) / mixing.BLOCK)


def test_mix(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    m = mixing.mix(d)
    r = m.select("doc_id", "source", "size", "source_size", "target", "taken").toPandas()
    assert (r.taken <= 2 * r["size"]).all()
    g = r.groupby("source").agg(t=("target", "max"), k=("taken", "sum"), s=("size", "sum"), n=("source_size", "max"))
    assert ((g.k - g.t).abs() <= 2 * mixing.BLOCK).all() and (g.s == g.n).all()
    rows = mixing.mixed_rows(m, d.columns).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("k")).toPandas().set_index("source").k
    assert (rows.sort_index() == g.k.sort_index()).all()
    again = mixing.mix(d.repartition(7)).select("doc_id", "taken")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, m.select("doc_id", "taken").collect()))


@pytest.mark.parametrize("shards", [64, 5])
def test_mix_takes_each_shards_quota(spark, shards):
    sizes = {"a": 40_000, "b": 9_000, "c": 700, None: 33, "d": 12_345, "e": 0}
    rows = [(i, s, " ".join(["w"] * n)) for s, total in sizes.items() for i, n in enumerate([97] * (total // 97) + [total % 97])]
    r = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), shards=shards).collect()
    plan = {q.source: q for q in mixing.quotas(sizes, shards=shards)}
    assert any(q.extra for q in plan.values())
    chosen = {(x["source"], j) for x in r for j in x["chosen"]}
    got = {}
    for s, q in plan.items():
        assert len([j for t, j in chosen if t == s]) == q.extra
        for j in range(q.blocks):
            k = (s, (j + q.shard) % shards)
            got[k] = got.get(k, 0) + q.passes + ((s, j) in chosen)
    quota = {(s, k): n for s, k, n in mixing.shard_quotas(sizes, shards=shards)}
    assert quota == {k: got.get(k, 0) for k in quota}


def test_shard_quotas_stay_within_blocks():
    for n in range(1, 400, 7):
        for share in (Fraction(1, 3), Fraction(9, 8), Fraction(3, 2), Fraction(2)):
            q = mixing.quotas({"a": n, "b": 3 * n}, block=1, shards=8, share=share)
            seats = mixing.shard_quotas({"a": n, "b": 3 * n}, block=1, shards=8, share=share)
            for x in q:
                own = {k: s for y, k, s in seats if y == x.source}
                held = {k: x.short + ((k - x.shard) % 8 < x.blocks % 8) for k in own}
                assert sum(own.values()) == x.passes * x.blocks + x.extra
                assert all(x.passes * held[k] <= own[k] <= (x.passes + 1) * held[k] for k in own)


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out(F.col("doc_id")))
    p = langid.predict(d, langid.fit(d.filter("not held_out")), keep=("doc_id", "held_out", "lang")).filter("held_out").toPandas()
    assert (p.lang == p.lang_pred).mean() > 0.97
    assert p.score.between(0, 1).all()
    odd = langid.predict(spark.createDataFrame([(1, None), (2, "12 34"), (3, "")], "doc_id int, text string"), langid.fit(d.filter("not held_out")))
    assert {r["lang_pred"] for r in odd.collect()} == {"und"}


def test_language_costs_sum_to_one(spark):
    rows = [("en", "the cat sat on the mat, the cat ran"), ("en", None), ("el", "η γάτα κάθισε στο χαλί και έτρεξε"), ("ru", "кошка села на коврик и убежала"), (None, "never learned")]
    for nodes in (langid.NODES, 12):
        trees = langid.fit(spark.createDataFrame(rows, "lang string, text string"), nodes=nodes)
        assert [t.lang for t in trees] == ["el", "en", "ru"]
        for t in trees:
            assert all(len(k) <= nodes for k, _ in t.nodes.values())
            for context in (b"the", b"   ", "γ".encode() + b" ", b"zqx", "ко".encode()[:3]):
                c = np.frombuffer(context[:3], np.uint8).astype(np.uint32)
                codes = (c[0] << 24 | c[1] << 16 | c[2] << 8) + np.arange(256, dtype=np.uint32)
                total = np.exp2(-t.bits(codes)).sum()
                # without exclusion a lower order also gives room to bytes that the higher one has
                assert 0.2 < total < 1 + 1e-5


def test_language_by_brute_force(spark):
    train = [("a", "banana band"), ("b", "bonobo boom")]
    trees = langid.fit(spark.createDataFrame(train, "lang string, text string"))
    text = "ban boo"

    def cost(data, history, byte, order):
        if order < 0:
            return 8.0
        context = history[len(history) - order :]
        padded = b"   " + data
        after = [padded[i + order] for i in range(3 - order, len(padded) - order) if padded[i : i + order] == context]
        if not after:
            return cost(data, history, byte, order - 1)
        n, seen = after.count(byte), len(set(after))
        return -np.log2(n / (len(after) + seen)) if n else -np.log2(seen / (len(after) + seen)) + cost(data, history, byte, order - 1)

    for tree, (_, data) in zip(trees, train, strict=True):
        padded = b"   " + text.encode()
        want = sum(cost(data.encode(), padded[:i], padded[i], 3) for i in range(3, len(padded)))
        got, sizes = langid.code_lengths([tree], [text, "", text])
        assert np.allclose(got[:, 0], [want, 0, want], rtol=1e-5) and list(sizes) == [7, 0, 7]


def test_language_long_texts_in_pieces(spark, monkeypatch):
    trees = langid.fit(spark.createDataFrame([("a", "banana band"), ("b", "bonobo boom")], "lang string, text string"))
    texts = ["bandana " * 50, None, "b", "boom banana " * 30]
    whole = langid.code_lengths(trees, texts)
    monkeypatch.setattr(langid, "CHUNK", 7)
    parts = langid.code_lengths(trees, texts)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()


def test_small_language_beside_a_large_one(spark):
    rng = np.random.default_rng(8)
    big = [("xx", "".join(rng.choice(list("abcdefghijklmnop "), 400))) for _ in range(60)]
    trees = {t.lang: t for t in langid.fit(spark.createDataFrame([*big, ("yy", "qrst uvwz qrst")], "lang string, text string"), nodes=200)}
    alone = langid.fit(spark.createDataFrame([("yy", "qrst uvwz qrst")], "lang string, text string"), nodes=200)[0]
    for k in trees["yy"].nodes:
        assert (trees["yy"].nodes[k][0] == alone.nodes[k][0]).all()


@pytest.mark.parametrize("shape", [(1, 64), (2, 64), (5, 3)])
def test_images(shape):
    x = np.random.default_rng(1).integers(0, 256, (*shape, 3), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(x)) == x).all()
    assert (media.decode(media.encode_ppm(x)) == x).all()
    assert (media.decode(media.encode_pgm(x[:, :, 0])) == x[:, :, 0]).all()
    g = media.grey(x).astype(float)
    assert np.allclose(media.area_resize(g, 1, 1), g.mean())
    assert np.allclose(media.area_resize(g, *shape), g)


def test_media(spark):
    d = spark.createDataFrame([(1, "a" * 500), (2, None), (3, "a" * 500)], "doc_id int, text string")
    r = {x["doc_id"]: x for x in media.media_table(d).collect()}
    want = b"a" * 500 + b" " * 76
    assert (r[1]["n_bytes"], r[1]["payload_bytes"], r[1]["payload_sha256"], r[1]["tail_crc32"]) == (500, 576, hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
    assert r[1][2:] == r[3][2:] and r[2]["payload_bytes"] == 192


def test_media_query_writes_tiles(spark, tmp_path):
    text = "".join(chr(33 + (i * i) % 90) for i in range(192 * 5))
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.queries()["op8_media"](spark, str(tmp_path))
    assert out.columns[-1] == "tile" and all("/tiles-" in f for f in out.inputFiles())
    tiles = {r["doc_id"]: np.load(io.BytesIO(r["tile"])) for r in out.collect()}
    assert all(t.shape == (16, 16) and t.dtype == np.uint8 for t in tiles.values())
    # by brute force: every source pixel repeated so often that both grids fit
    x = np.frombuffer(text.encode(), np.uint8).reshape(5, 64, 3) @ np.array([299, 587, 114])
    big = np.repeat(x, 16, axis=0).reshape(16, 5, 16, 4)
    assert np.abs(tiles[1] - big.mean((1, 3)) / 1000).max() <= 0.5 + 1e-6
    assert (tiles[2] == 32).all()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>a &lt;b&gt; c", "a <b> c"),
        ('<body><header>Site</header><div id=c><h1>Title</h1><p>Hello, this is a long paragraph, with commas, and text.</p><p>Second one, which is also long enough.</p></div><div class="comments"><p>Great article, thanks, wow, so good, really.</p></div></body>', "Title\nHello, this is a long paragraph, with commas, and text.\nSecond one, which is also long enough."),
        ("<article><p>one  two<br>three<p>four</article><footer>x</footer>", "one two three\nfour"),
    ],
)
def test_main_text(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize("attribute", ['style="overflow:hidden"', 'title="hidden gem"', 'data-id="ad-3"', "data-role=navigation", 'alt="class=menu"'])
def test_attribute_values_are_no_names(attribute):
    text = "A long enough paragraph, with commas, and words to score."
    assert html.extract(f"<body><nav>menu</nav><div {attribute}><p>{text}</p></div></body>") == text


def test_deep_pages_take_linear_time():
    import time

    began = time.perf_counter()
    assert html.extract("<div>" * 100_000 + "<p>A long enough paragraph, with commas, and words.</p>" + "</div>" * 100_000).startswith("A long")
    assert "words" in html.extract("<div><span>x " * 50_000 + "<p>A long enough paragraph, with commas, and words.</p>")
    assert time.perf_counter() - began < 20


def test_links_count_at_any_depth():
    page = html.Page('<div><p><a href="x">' + "<b>" * 12 + "linked text, all of it, quite long" + "</b>" * 12 + "</a></p></div>")
    assert page.blocks[0][2] == len("linked text, all of it, quite long") and max(html.points(page)) == 0


def test_points_by_brute_force():
    import duckdb

    for (page,) in duckdb.sql(f"select html from '{SF}/pages.parquet' where html is not null").fetchall():
        p = html.Page(page)
        want = [0.0] * len(p.tag)
        for node in range(1, len(p.tag)):
            for owner, text, links in p.blocks:
                if len(text) < 25 or p.tag[owner] in html.HEADING:
                    continue
                up = [owner]
                while up[-1] > 0:
                    up.append(p.parent[up[-1]])
                up = [x for x in (up[1:] if p.tag[owner] in html.PROSE else up) if x > 0][:5]
                if node in up:
                    want[node] += (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - links / len(text)) / (1 + up.index(node))
        assert np.allclose(html.points(p), want)


def test_warc_damage(spark):
    d = spark.createDataFrame([(1, "http://x/", "a" * 90_000), (2, "http://y/", "b" * 90_000), (3, "http://z/", "short"), (4, "http://w/", "a" * 90_000)], "page_id long, url string, html string")
    chunks = warc.write_archive(d)

    def read(x):
        return {r["key"]: r["valid"] for r in warc.read_chunks(x).collect()}

    assert read(chunks) == {1: True, 2: True, 3: True, 4: True}
    lost = [("first", "chunk <> 0"), ("middle", "chunk <> 1"), ("last", "not last")]
    for _, keep in lost:
        assert read(chunks.filter(f"key <> 1 or {keep}")) == {1: False, 2: True, 3: True, 4: True}
    assert read(chunks.withColumn("data", F.when((F.col("key") == 2) & (F.col("chunk") == 1), F.encode(F.regexp_replace(F.decode("data", "utf-8"), "b", "c"), "utf-8")).otherwise(F.col("data")))) == {1: True, 2: False, 3: True, 4: True}
    assert read(chunks.withColumn("chunk", F.when((F.col("key") == 2) & (F.col("chunk") > 0), 3 - F.col("chunk")).otherwise(F.col("chunk")).cast("int")).withColumn("last", F.when((F.col("key") == 2) & (F.col("chunk") > 0), F.col("chunk") == 2).otherwise(F.col("last")))) == {1: True, 2: False, 3: True, 4: True}
    heads = {r["key"]: bytes(r["data"][:600]).split(b"\r\n\r\n")[0].decode() for r in chunks.filter("chunk = 0").collect()}
    named = {re.search(r"WARC-Record-ID: (\S+)", h)[1] for h in heads.values()}
    assert len(named) == 4 and re.search(r"WARC-Refers-To: (\S+)", heads[4])[1] == re.search(r"WARC-Record-ID: (\S+)", heads[1])[1] in named


def test_warc_bytes(spark):
    d = spark.createDataFrame([(2, "http://x/", "é" * 40000), (1, "http://y/", "é" * 40000), (3, None, "")], "page_id int, url string, html string")
    chunks = warc.write_archive(d)
    assert chunks.count() > 3
    whole = b"".join(r["data"] for r in chunks.filter("key = 1").orderBy("chunk").collect())
    head, _, rest = whole.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head.split(b"msgtype")[1])[1])
    assert head.startswith(b"WARC/1.1") and len(rest) == size + 4 and rest.endswith(b"\r\n\r\n")
    got = {r["key"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["valid"]) for r in warc.read_chunks(chunks).collect()}
    assert got == {1: ("response", None, 80000, True), 2: ("revisit", 1, 80000, True), 3: ("response", None, 0, True)}


def test_url_lists_times(spark):
    events = spark.createDataFrame([("www.Bad.com", "l", "add", 10), ("bad.com", "l", "remove", 20), ("bad.com/x", "m", "add", 5), ("bad.com", "l", "add", 30)], "pattern string, list string, action string, at long")
    caps = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate([("http://bad.com/", 9), ("http://a.bad.com/", 10), ("http://bad.com/x/y", 20), ("http://bad.com/", 35), (None, 15), ("", 15), ("http://notbad.com/", 15)])], "id int, url string, fetched_at long")
    got = {r["id"]: r["lists"] for r in urllists.match(caps, events).collect()}
    assert got == {0: [], 1: ["l"], 2: ["m"], 3: ["l"], 4: [], 5: [], 6: []}


def test_url_lists_deep_paths(spark):
    events = spark.createDataFrame([("bad.com/a/b/c/d", "l", "add", 1), ("worse.com/1/2/3/4/5/6", "m", "add", 1)], "pattern string, list string, action string, at long")
    urls = ["http://bad.com/a/b/c/d", "http://x.bad.com/a/b/c/d/e?q", "http://bad.com/a/b/c", "http://worse.com/1/2/3/4/5/6/7", "http://worse.com/1/2/3/4/5"]
    caps = spark.createDataFrame([(i, u, 5) for i, u in enumerate(urls)], "id int, url string, fetched_at long")
    assert {r["id"]: r["lists"] for r in urllists.match(caps, events).collect()} == {0: ["l"], 1: ["l"], 2: [], 3: ["m"], 4: []}
