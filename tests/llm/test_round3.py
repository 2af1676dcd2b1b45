"""Prefix trie, periodic runs and language identification against brute force, transforms against sums, held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quarry.llm import language, periodic, prefix_trie, queries

NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_nodes(sequences):
    """The trie's rows from {conv_id: [(role, text), ...]}."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        kids = [below(k) for k in children.get(node, ())]
        return own + sum(k[0] for k in kids), sum(k[1] for k in kids) or 1

    out = set()
    for node, convs in members.items():
        saved, leaves = below(node)
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), len(children.get(node, ())), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def sequences_of(rows):
    """{conv_id: turns} as the operator orders them."""
    keyed = {}
    for c, turn, role, text in rows:
        if c is not None:
            named = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16]
            keyed.setdefault(c, []).append((turn is not None, turn or 0, named, role or "", text or ""))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in keyed.items()}


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("limit", [1, 6, 1024])
def test_trie_equals_brute_force(spark, limit):
    draw = random.Random(3)
    rows = []
    for c in range(60):  # a spine that many share, a hot copied conversation, and loose ends
        spine = draw.choice([0, 3, 9])
        rows += [(c, t, "user", f"spine {t}") for t in range(spine)]
        rows += [(c, spine + t, draw.choice(["user", "tool"]), f"x{draw.randrange(3)}" * draw.randrange(1, 4)) for t in range(draw.randrange(4))]
    rows += [(c, t, "user", f"copied {t}") for c in range(100, 120) for t in range(5)]
    rows += [(200, None, None, None), (200, 1, "user", ""), (200, 1, "user", ""), (201, None, "", ""), (None, 1, "user", "nobody's"), (202, 0, "user", "long " * 9000), (203, -1, "us", "er"), (204, -1, "user", "")]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("place", F.lit(1)).withColumn("seq", F.lit("clash")).repartition(5)
    got = prefix_trie.trie(df, limit)
    assert got.columns == NODES
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_nodes(sequences_of(rows))


def test_trie_query_on_missing_bases_and_empty_tables(spark, tmp_path):
    draw = random.Random(4)
    rows = [(c, t, "user", f"{draw.randrange(2)}") for c in [*range(3, 40), *range(100, 130), *range(1000, 1003)] for t in range(draw.randrange(1, 8))]
    spark.createDataFrame(rows, CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    own = sequences_of(rows)
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    assert {tuple(r) for r in queries.op11_prefix_trie(spark, str(tmp_path)).collect()} == brute_nodes(want)
    assert prefix_trie.trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_digest_of_a_large_group_of_copies(spark):
    members = spark.range(0, 30_000, 7, 5).select(F.when(F.col("id") < 5000, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("seq"), F.col("id").alias("conv_id"))
    lists = {1: range(0, 5000, 7), 0: range(5005, 30_000, 7)}
    want = {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in lists.items()}
    assert {r["seq"]: r["ends_sha256"] for r in prefix_trie.digested(members).collect()} == want


def brute_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(12, 2 * q):
                out.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in out.items())


@pytest.mark.parametrize(("block", "window"), [(2, 7), (4, 11), (64, 191), (1024, 3071), (4096, 9001)])
def test_squared_differences_are_exact(block, window):
    draw = np.random.default_rng(block)
    symbols = int((65536 / block) ** 0.5) + 1
    blocks, windows = draw.integers(0, symbols, (3, block)).astype(float), draw.integers(0, symbols, (3, window)).astype(float)
    windows[1, 3 : 3 + block] = blocks[1]
    blocks[2], windows[2] = symbols - 1, 0  # the largest sum
    want = [[((b - w[k : k + block]) ** 2).sum() for k in range(window - block + 1)] for b, w in zip(blocks, windows, strict=True)]
    assert (periodic.mismatches(blocks, windows) == np.array(want)).all()


def test_runs_equal_brute_force():
    draw = random.Random(5)
    for _ in range(150):
        docs = []
        for _ in range(draw.randint(1, 4)):
            words, kinds, size = [], draw.choice([1, 2, 3, 30]), draw.randint(0, 260)
            while len(words) < size:
                if draw.random() < 0.4 or not words:
                    words += [draw.randrange(kinds) for _ in range(draw.randint(1, 10))]
                else:
                    back = draw.randint(1, min(len(words), 60))
                    for _ in range(draw.randint(1, 120)):
                        words.append(words[-back])
            docs.append([b"%d" % w for w in words])
        for words, (runs, text) in zip(docs, periodic.summaries(docs), strict=True):
            assert runs == sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
            dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
            assert text == b" ".join(w for i, w in enumerate(words) if i not in dropped)


def test_long_periods_and_windows_beyond_one_transform(monkeypatch):
    monkeypatch.setattr(periodic, "WIDE", 64)  # blocks beyond it are represented by their beginning
    draw = random.Random(6)
    for period, length in ((700, 1900), (1023, 2046), (300, 5000)):
        words = [b"%d" % draw.randrange(40) for _ in range(period)]
        tail = [b"%d" % draw.randrange(40, 80) for _ in range(200)]
        text = tail + [words[i % period] for i in range(length)] + tail[::-1]
        (runs, _), = periodic.summaries([text])
        assert runs == brute_runs(text) and (200, length, period) in runs
    assert periodic.summaries([[b"a"] * 50_000 + [b"b"] + [b"a"] * 50_000])[0][0] == [(0, 50_000, 1), (50_001, 50_000, 1)]


def test_periodic_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_periodic(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]] or "")
        if len(words) > 1500:
            continue
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = sorted(brute_runs(words), key=lambda x: (x[0], x[2]))
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        want = (*top, 1000 * top[1] // top[2]) if runs else (None,) * 4
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *want)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()
    assert sum(r["n_runs"] > 0 for r in got) >= len(got) // 20


def test_spans_on_odd_tables(spark):
    rows = [(1, None, "kept"), (2, "", "kept"), (3, " \n", "kept"), (4, "a b " * 12, "kept"), (4, "a b " * 12, "kept"), (None, "x y " * 40_000, "kept"), (2**60 + 1, "w" * 50_000, "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("_runs", F.lit(1))
    got = periodic.spans(df)
    assert got.columns == [*df.columns, "collapsed"]
    found = sorted(((r["doc_id"] or 0, [tuple(s) for s in r["runs"]], r["collapsed"]) for r in got.collect()), key=str)
    assert found == sorted([(0, [(0, 80_000, 2)], "x y"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 12, 1)], "a b"), (4, [(0, 12, 1)], "a b"), (2**60 + 1, [], "w" * 50_000)], key=str)
    assert periodic.spans(df.limit(0)).count() == 0


def test_language_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    found = queries.op13_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    out = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)


def test_network_gradient_and_tables():
    net = language.Network(["a", "b", "c"])
    draw = np.random.default_rng(1)
    x, y = draw.integers(0, 256, (6, 40)), draw.integers(0, 3, 6)
    loss, grad = net.gradients(x, y)
    for name, at in (("s", (3, 1)), ("c", (2,)), ("b3", (5,)), ("w2", (1, 2, 3)), ("w4", (3, 1, 7)), ("e", (int(x[0, 7]), 4))):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-6
        assert abs((net.gradients(x, y)[0] - loss) / 1e-6 - grad[name][at]) < 1e-4
        net.p[name][at] = keep
    assert np.abs(net.pooled(x)[0] - net.features(x.astype(np.uint8))).max() < 1e-4
    text = bytes(draw.integers(0, 256, 5000, dtype=np.uint8))
    windows = language.windows_of(text)
    assert all(any(text[i : i + 4] in w.tobytes() for w in windows) for i in range(len(text) - 3))
    assert np.allclose(net.probabilities([text, b"x", text])[0], net.probabilities([text])[0])


def test_language_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, lang_pred int, _language string"
    rows = [(i, f"wort satz {i} über größe" if i % 2 else f"word sentence {i} the whether", "de" if i % 2 else "en", 1, "x") for i in range(40)]
    odd = [(None, "the word", "en", 1, "x"), (50, None, "en", 1, "x"), (51, "", None, 1, "x"), (52, "123 !?", "de", 1, "x"), (53, "größe satz " * 20_000, None, 1, "x"), (53, "größe satz", None, 1, "x")]
    df = spark.createDataFrame(rows + odd, schema)
    got = language.predict(df, language.train(df)).collect()
    assert len(got) == 46 and {r["lang_pred"] for r in got if r["doc_id"] in (50, 51, 52)} == {"und"}
    assert [r["lang_pred"] for r in got if r["doc_id"] == 53] == ["de", "de"] and all(r["_language"] == "x" for r in got)
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") for r in got)
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language.predict(none, language.train(none)).collect()} == {("und", 0.0)}
    one = df.where("lang = 'de'")
    assert {r["lang_pred"] for r in language.predict(df, language.train(one)).collect()} == {"und", "de"}
    assert language.train(df.limit(0)) is None and language.predict(df.limit(0), None).count() == 0


def test_ngram_join_with_more_buckets_than_shingles(spark, docs, monkeypatch):
    from quarry.llm import ngram_join

    want = sorted(map(tuple, ngram_join.join(docs).collect()))
    monkeypatch.setattr(ngram_join, "SHINGLES_PER_BUCKET", 1 / 64)
    monkeypatch.setattr(ngram_join, "PARTITIONS", 6)
    assert sorted(map(tuple, ngram_join.join(docs).collect())) == want


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_match_runs_through_states(monkeypatch, docs):
    import public_tokenizers

    from quarry.llm import bpe

    machine = bpe.Transducer(bpe.read_ranks(queries.MULTI))
    made, asked = [0], [0]
    advance = machine.advance
    monkeypatch.setattr(machine, "advance", lambda at, byte: (made.__setitem__(0, made[0] + 1), advance(at, byte))[1])
    import regex

    split = regex.compile(public_tokenizers.PATTERN).findall
    words = {m.encode() for r in docs.limit(150).collect() for m in split(r["text"] or "")} - machine.ranks.keys()
    for w in words:
        asked[0] += len(w)
        assert b"".join(machine.bytes_of[i] for i in machine.run(w)) == w
    # each byte follows a transition: made once, or there already
    assert len(words) > 1000 and made[0] == len(machine.step) and made[0] < asked[0] / 2
    monkeypatch.setattr(bpe, "STATES", 50)
    long = bytes(random.Random(8).choices(range(97, 123), k=20_000))
    assert b"".join(machine.bytes_of[i] for i in machine.run(long)) == long and len(machine.states) <= 51


def test_stream_gives_bytes_that_are_no_text():
    from quarry.llm import bpe

    decoder, ranks = bpe.decoder(queries.MULTI), bpe.read_ranks(queries.MULTI)
    raw = bytes(random.Random(9).choices(range(256), k=3000))
    ids = bpe.packed([ranks[raw[i : i + 1]] for i in range(len(raw))])
    chunks = lambda: (ids[i : i + 28] for i in range(0, len(ids), 28))
    assert "".join(decoder.stream(chunks(), bpe.ESCAPE)).encode(errors=bpe.ESCAPE) == raw
    assert "".join(decoder.stream(chunks())) == raw.decode(errors="replace")


def test_inflation_is_bounded():
    import gzip
    import io

    from quarry.llm import warc

    whole = b"\0" * 50_000_000 + bytes(random.Random(1).choices(range(256), k=100_000)) + b"a" * 7
    packed = gzip.compress(whole) + gzip.compress(b"second") + gzip.compress(b"")
    pieces = list(warc.inflated(io.BytesIO(packed)))
    assert b"".join(pieces) == whole + b"second" and max(map(len, pieces)) <= warc.CHUNK


def test_classifier_sample_is_bounded_by_passages(spark, monkeypatch):
    from quarry.llm import quality

    rows = [(i, ("plain words of a calm text " if i % 2 else "$$$ !!! ### %% ") * (3 + i % 5)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    used = []
    monkeypatch.setattr(quality.Model, "train", lambda self, x, number, y: used.append((len(number), len(x))))
    quality.train(docs, labels)
    monkeypatch.setattr(quality, "SAMPLE_PASSAGES", 30)
    quality.train(docs, labels)
    assert used[0][0] > 60 and used[1] == (30, 30)
    monkeypatch.setattr(quality, "SAMPLE_PASSAGES", 0)
    assert quality.train(docs, labels).prior == 0.5 and len(used) == 2


def test_exact_stage_carries_map_columns(spark):
    import corpus_pipeline

    rows = [(2, "a  b", {"k": 2}), (1, "a b", {"k": 1}), (1, "a b", {"k": 0}), (1, "a b", {"k": 0}), (3, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, meta map<string,int>")
    got = sorted((r["doc_id"], r["text"], r["meta"]) for r in corpus_pipeline.exact(spark, docs, SF).collect())
    assert got == [(1, "a b", {"k": 0}), (3, "c", None)]
