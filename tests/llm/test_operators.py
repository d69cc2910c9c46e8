"""Each corpus operator against a brute-force version, an exact round trip, or held-out rows; and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidewater.llm import common, decontaminate, hashing, line_rules, parity_join, piece_codec, quality_knn, sharding, style_tree, token_index, toxicity_gru, url_rules
from tidewater.llm.common import shared_dir

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "x" * 70_000), (6, "a b c d e f"), (6, "a b c d e f"), (7, "é ☃ 😀 ▁ \x1c \x00"), (8, "line one.\nline one.\n| a | b | c |")]


def test_sharding(make_docs, prose):
    rows = [(k, prose(k, 20 + k % 50)) for k in range(800)] + ODD
    out = sharding.shard_documents(make_docs(rows), shards=24).toPandas()
    assert len(out) == len(rows) and set(out["law"]) == {"bytes"} and out["shard"].between(0, 23).all() and out["grown_shard"].isna().all()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    light = out[out["size"] < 60_000].groupby("shard")["size"].sum()
    assert sorted(light)[-1] - sorted(light)[2] < 600  # but for the shard with the huge text
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted(zip(out["size"], out["text_crc32"], strict=True)) == want
    # each virtual slot is in one shard, and the newest map gives it
    assert (out.groupby("virtual_slot")["shard"].nunique() == 1).all() and set(out["map_version"]) == {1}
    assert out[out["size"] < 60_000].groupby("shard")["size"].sum().min() > 0


@pytest.mark.parametrize("way", ["broadcast", "shuffled"])
def test_sharding_of_repeated_rows(make_docs, prose, monkeypatch, way):
    """A third of all rows is one row: sizes stay near equal."""
    if way == "shuffled":
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = [(k, prose(k, 20 + k % 50)) for k in range(2000)] + [(7, prose(7, 27))] * 1000 + [(None, None)] * 50
    out = sharding.shard_documents(make_docs(rows), shards=24).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == len(rows) and len(sizes) == 24 and sizes.max() < 1.1 * sizes.mean() and sizes.min() > 0.9 * sizes.mean()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_sharding_of_nothing(make_docs):
    assert sharding.shard_documents(make_docs([])).count() == 0


def test_rebalancing_moves_little(spark, make_docs, prose, tmp_path):
    docs = make_docs([(k, prose(k, 30)) for k in range(300)])
    loads = sharding.slot_loads(sharding.records(docs, 64), 64)
    one = sharding.rebalance(sharding.first_map(spark, 4, 64), loads, 4)
    two = sharding.rebalance(one, loads, 4)
    assert one.count() == two.count() == 64
    moved = one.join(two.withColumnRenamed("shard", "to"), "virtual_slot").where("shard <> to").count()
    assert moved <= 8
    sharding.store_map(one, str(tmp_path / "m"))
    sharding.store_map(two, str(tmp_path / "m"))
    assert {r.version for r in sharding.load_map(spark, str(tmp_path / "m")).collect()} == {2}


def brute_base(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    seen, hit = {}, set()
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    for at in seen.values():
        if len(at) > 1:
            hit |= {p + q for p in at for q in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_line_rules(make_docs, prose):
    rnd = random.Random(3)
    rows = [(k, "\n".join(prose(rnd.randint(0, 6), rnd.randint(0, 40)) + rnd.choice([".", "", " | x | y |", "&&&"]) for _ in range(rnd.randint(1, 6)))) for k in range(60)] + ODD
    out = line_rules.judged(make_docs(rows)).toPandas()
    got = sorted(out[["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]].values.tolist())
    assert got == sorted([k, *brute_base(t)] for k, t in rows)
    assert not (out["kept"] & out["base_failed"]).any()
    assert line_rules.judged(make_docs([])).count() == 0


def test_line_rules_verdicts(make_docs, prose):
    good = "\n".join(" ".join(f"word{k}{j}" for j in range(15)) + "." for k in range(6))
    menu = "\n".join(f"home{k} | about{k} | news{k} | more{k} | x{k} | y{k} | z{k} | w{k} | v{k}" for k in range(9))
    noisy = " ".join(f"so{k}&&& it{k}$$$" for k in range(60)) + "."
    docs = make_docs([(1, good), (2, menu), (3, noisy), (4, good + "\nWe use cookies on this site.\nCopyright 2020 by us.")])
    assert {r.doc_id: r.kept for r in line_rules.judged(docs).collect()} == {1: True, 2: False, 3: False, 4: True}
    assert {r.doc_id: r.text for r in line_rules.clean(docs).collect()} == {1: good, 4: good}


def jaccard_components(rows, size=5):
    sets, out = {}, {}
    for k, (i, t) in enumerate(rows):
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(" ") if w]
        sets[k] = {tuple(words[a : a + size]) for a in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    for k, (i, _) in enumerate(rows):
        out.setdefault(i, []).append((len(sets[k]), least[root(k)]))
    return sorted((i, *v) for i, vs in out.items() for v in vs)


@pytest.mark.parametrize("way", ["broadcast", "shuffled"])
def test_parity_join(make_docs, prose, monkeypatch, way):
    """Against brute force, with candidates broadcast and shuffled, and with groups and buckets cut in small blocks."""
    if way == "shuffled":
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(parity_join, "BLOCK", 4)
        monkeypatch.setattr(parity_join, "DEAL_SHINGLES", 500)
        monkeypatch.setattr(parity_join, "CHUNK", 2)
        monkeypatch.setattr(parity_join, "BUCKET_BLOCK", 3)
    rnd = random.Random(9)
    rows = []
    for group in range(14):
        base = prose(group, rnd.choice([5, 7, 9, 14, 30, 80, 200])).split()
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(["zig", "zag", "ZOG"])
            if rnd.random() < 0.2:
                copy += ["tail"] * rnd.randint(1, 8)
            rows.append((len(rows) + 10, " ".join(copy)))
    rows += [(1, None), (2, ""), (3, " \n "), (4, "One"), (5, "one"), (6, "a b c d e f"), (7, "A B C D E F"), (6, "a b c d e f"), (8, prose(5, 9000)), (8, prose(6, 60)), (9, prose(5, 9000) + " end")]
    out = parity_join.linked_documents(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == jaccard_components(rows)


def test_sketch_bound():
    """The bound pair by pair agrees with the one in blocks, and never rules out similar sets."""
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (5, 8, 40, 41, 300)]
    sets += [np.unique(np.concatenate([s[: -max(1, len(s) // 10)], rng.integers(0, 1 << 63, 1).astype(np.uint64)])) for s in sets]
    sketches, sizes = [parity_join.sketch(s) for s in sets], np.array([len(s) for s in sets])
    block = parity_join.close(sketches, sketches, sizes, sizes, 80)
    a, b = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets)), indexing="ij"))
    pairs = parity_join.bound_holds([sketches[k] for k in a], [sketches[k] for k in b], sizes[a], sizes[b], 80)
    assert np.array_equal(pairs.reshape(block.shape), block >= 0)
    assert all(pairs[k] for k in range(len(a)) if parity_join.similar(sets[a[k]], sets[b[k]], 80))
    assert not pairs.all()


def test_one_of_each(make_docs, prose):
    text = prose(1, 60)
    docs = make_docs([(1, text), (2, text), (3, prose(2, 60)), (3, prose(2, 60)), (4, None), (None, "x y z")])
    out = parity_join.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 1), (False, 3), (False, 4), (True, None)]
    assert parity_join.linked_documents(make_docs([])).count() == 0


def test_pieces_never_miss(prose):
    """Pigeonhole: sets within the bound agree in a piece of their band, whatever their sizes."""
    rng = np.random.default_rng(4)
    for n in [*range(4, 60), 150, 700]:
        for _ in range(4):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            d = parity_join.most_apart(2 * len(a))
            drop = int(rng.integers(0, d // 2 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, d // 2 + 1))).astype(np.uint64)]))
            if not parity_join.similar(a, b, 80) or np.array_equal(a, b):
                continue
            keys = [{int(k) for i in (0, 1) for k in parity_join.pieces_of(x, parity_join.band_of(len(x)) + i, 80)} for x in (a, b)]
            assert keys[0] & keys[1]
            assert parity_join.close([parity_join.sketch(a)], [parity_join.sketch(b)], np.array([len(a)]), np.array([len(b)]), 80)[0, 0] >= 0


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    rest = rest.split("#")[0].split("?")[0]
    host = rest.split("/")[0]
    path = rest[len(host) :]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = (-1, "", None, "allow")
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (len(h + p), v) > best[:2]:
            best = (len(h + p), v, h + p, v)
    return host, path, best[2], best[3]


def test_url_rules(spark):
    rnd = random.Random(2)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("com", "/a", "block"), ("x.com", "/", "allow"), ("b.x.com", "/a/b", "block"), ("x.com", "/a/b/c", "allow")]
    hosts = ["m.Example.NET", "example.net", "net", "x.com", "b.x.com", "c.b.x.com", "xx.com", "org", "", "com"]
    urls = [f"http://{rnd.choice(hosts)}{rnd.choice(['', '/', '/a', '/a/b', '/a/b/c/d', '/en/x', '?q=/a', '#/a', '/en/?x#y'])}" for _ in range(400)] + [None, "", "nothing", "a://b://c/d"]
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    out = url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out) == [(k, *brute_url(u, rules)) for k, u in enumerate(urls)]
    twice = url_rules.judge_urls(pages.unionByName(pages), spark.createDataFrame(rules + rules[:2], "host string, path string, verdict string")).collect()
    assert sorted((r.page_id, r.verdict) for r in twice) == sorted((r.page_id, r.verdict) for r in out * 2)
    assert url_rules.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_token_index(spark, make_docs, prose):
    """Whole tables and single keys against the library, with repeated, null and extreme keys and empty tables."""
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    low = -(1 << 63)
    rows = [(k + 20, prose(k, 10 + k)) for k in range(40)] + ODD + [(9, "It's Σίσυφος İ, ﬁ é 12x3 <|endoftext|>"), (6, "third"), (None, "no key"), (None, "nor here"), (0, "zero"), (low, "least")]
    path = f"{shared_dir(spark)}/segments-test"
    token_index.write_segments(make_docs(rows), file, path, parts=3)
    out = sorted(token_index.documents_of(token_index.read_segments(spark, path)).collect(), key=lambda r: r.start)
    tokenizer, start = Tokenizer.from_file(file), 0
    encoded = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert [r.doc_id for r in out] == [None, None, *sorted(k for k, _ in rows if k is not None)]
    for r in out:
        assert r.start == start
        start += r.n_tokens
    by_key = lambda rs: sorted(rs, key=repr)
    assert by_key((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == by_key((k, len(encoded(t)), crc(encoded(t))) for k, t in rows)
    for key in (None, low, 0, 4, 6, 25):
        assert by_key(x.tolist() for x in token_index.ids_of(spark, path, key)) == by_key(encoded(t) for k, t in rows if k == key)
    assert token_index.ids_of(spark, path, 10**12) == []
    token_index.write_segments(make_docs([]), file, f"{path}-empty", parts=3)
    assert token_index.documents_of(token_index.read_segments(spark, f"{path}-empty")).count() == 0


def test_index_is_read(spark, make_docs, prose):
    """A wrong seed or fingerprint is no silent loss: the query's rows come through the index."""
    from pyspark.sql import functions as F

    path = f"{shared_dir(spark)}/segments-wrong"
    token_index.write_segments(make_docs([(k, prose(k, 5)) for k in range(50)]), public_tokenizers.path("word_bpe_49k.json"), path, parts=1)
    rows = token_index.read_segments(spark, path)
    wrong = rows.withColumn("seeds", F.lit(bytes(4 * 13)))
    with pytest.raises(Exception, match="lacks some of its keys"):
        token_index.documents_of(wrong).collect()


def test_word_tokenizer():
    """Against the library, whole texts, with names of special tokens as written and in capitals."""
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    letters = [*"abXYé À.,!?'\n\t\u00a0²Ⅷ0١_ıİΣς<|>-#*\u0301日ﬁ😀", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "don't", "Word,"]
    texts = ["", " ", *("".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000))]
    got = token_index.WordTokenizer(path).encode(texts, b"\1\0\0\0")
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [[*w.ids, 1] for w in want]


def test_words_are_met_once(monkeypatch):
    """Of a word's many spellings and marks, and of all texts, Python sees the letters once and the marks once; Arrow lays out the rest."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path, met = public_tokenizers.path("word_bpe_49k.json"), []
    learn = token_index.WordTokenizer.learn
    monkeypatch.setattr(token_index.WordTokenizer, "learn", lambda self, words: met.append(words) or learn(self, words))
    texts = ["Word word. WORD!!", "worD,, word\nWord. ", "word", "", "été. été!!"]
    words = token_index.WordTokenizer(path)
    want = [[*e.ids, 1] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for given in (pa.array(["no", *texts]).slice(1), texts):
        assert [np.frombuffer(g, "<u4").tolist() for g in words.encode(given, b"\1\0\0\0")] == want
    assert met[0] == {"word", "été", ".", "!!", ",,", ""} and not met[1] and words.encode([], b"") == []


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_perfect_hash(n):
    keys = list(range(0, 7 * n, 7))
    rows = [*keys, None, 7, None]
    ids = [np.full(k % 5, k, "<u4").tobytes() for k in range(len(rows))]
    segment = token_index.pack(rows, ids)
    seen = Counter()
    for key, own in zip(rows, ids, strict=True):
        assert token_index.lookup(*segment, key, seen[key]) == own
        seen[key] += 1
    assert all(token_index.lookup(*segment, key, times) is None for key, times in seen.items())
    assert all(token_index.lookup(*segment, k) is None for k in range(10**6, 10**6 + 200))


def test_piece_codec(make_docs, monkeypatch):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    rnd = random.Random(1)
    parts = [*"abcdetions theränéèß.,!&$%123\n\t  ▁", "ing", "tion", "😀", "日", "œ", "</s>", "<0x0A>"]
    rows = [(100 + k, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))) for k in range(300)] + ODD
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.digests(make_docs(rows), file).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, t in rows:
        ids = model.encode(t or "")
        want.append((k, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    assert got == sorted(want)
    assert piece_codec.digests(make_docs([]), file).count() == 0
    codec = piece_codec.PieceCodec(file)
    odd = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(30_000)]
    monkeypatch.setattr(piece_codec, "KEPT_WORDS", 1000)  # the tables turn over
    got = [row for k in range(0, len(odd), 500) for row in codec.digests(odd[k : k + 500])]
    for row, t, ids in zip(got, odd, model.encode(odd), strict=True):
        assert row == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))
    assert max(len(codec.young), len(codec.old)) < 10_000 and not codec.passing
    for text in ("x" * 200_000, "abcdefghij" * 20_000, "ab" * 3 + "q" * 50_000):
        assert codec.encode(text) == model.encode(text)
    for _ in range(300):
        ids = [rnd.randrange(3, 300) if rnd.random() < 0.7 else rnd.randrange(3, 32000) for _ in range(rnd.randint(0, 8))]
        assert codec.decode(ids) == model.decode(ids)


def edits(item, text):
    prev = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        cur = [i]
        for j, c in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (w != c)))
        prev = cur
    return min(prev)


def test_decontamination(spark, make_docs, prose):
    rnd = random.Random(5)
    items = [(k, prose(1000 + k, rnd.randint(0, 25))) for k in range(6)]
    rows = list(ODD)
    for k in range(60):
        words, item = prose(k, rnd.randint(0, 60)).split(), rnd.choice(items)[1].split()
        for _ in range(rnd.randint(0, 6)):
            if item:
                item[rnd.randrange(len(item))] = rnd.choice(["zig", "zag zog", ""])
        at = rnd.randint(0, len(words))
        rows.append((k + 100, " ".join(words[:at] + item + words[at:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(make_docs(rows), bench).collect()}
    want = {(k, i, e) for k, t in rows for i, x in items if x and (e := edits(x.split(), (t or "").lower().split())) <= len(x.split()) // 5}
    assert got == want and want
    left = {r.doc_id for r in decontaminate.without_contaminated(make_docs(rows), bench).collect()}
    assert left == {k for k, _ in rows} - {k for k, _, _ in want}
    assert decontaminate.contaminated(make_docs(rows), bench.limit(0)).count() == 0


def test_quality(spark, make_docs, prose):
    rows = [(k, prose(k, 60) if k % 2 else prose(k, 60).upper().replace(" ", "!! ")) for k in range(240)] + [(1000 + i, t) for i, t in ODD]
    labels = spark.createDataFrame([(k, k % 2) for k in range(240)] + [(500, None)], "doc_id long, quality int")
    out = quality_knn.scored(make_docs(rows), labels).toPandas().set_index("doc_id")
    assert len(out) == len(rows) and out["score"].between(0, 1).all()
    assert all(out["predicted"][k] == k % 2 for k in range(240))
    assert all(out["held_out"][k] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(240))
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) = 1 THEN 1 - quality ELSE quality END AS quality")
    again = quality_knn.scored(make_docs(rows), flipped).toPandas().set_index("doc_id")
    assert again["score"].sort_index().equals(out["score"].sort_index())  # held-out labels play no part
    assert quality_knn.scored(make_docs(rows), labels.limit(0)).count() == len(rows)
    good = quality_knn.good_only(make_docs(rows), labels)
    assert good.columns == make_docs([]).columns and {r.doc_id for r in good.collect()} >= {1, 3, 5}


def test_quality_is_of_the_text_alone(spark, make_docs, prose):
    """Equal texts score alike whatever stands beside them and however the table is dealt; votes against plain Python."""
    rnd = random.Random(8)
    texts = [prose(k, 30) if k % 2 else prose(k, 30).upper() + "!!" for k in range(120)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[k % 7]) for k in range(60)] + [(2000, "x"), (2001, "ab"), (2002, "é")] + [(3, prose(3, 30))]
    rnd.shuffle(rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)] + [(3, 0)], "doc_id long, quality int")
    docs = make_docs(rows)
    one, seven = ({(r.doc_id, r.score) for r in quality_knn.scored(docs.repartition(n), labels).collect()} for n in (1, 7))
    assert one == seven
    score = dict(one)
    assert all(score[1000 + k] == score[k % 7] for k in range(60))
    model = quality_knn.fitted(docs, labels)
    for t in [*texts[:20], "", "zzz qqq"]:
        counts = quality_knn.term_counts([t.encode()])
        own = quality_knn.latent(quality_knn.weighted(counts, model["idf"]), model["axes"])[0]
        dots = [sum(int(a) * int(b) for a, b in zip(own, v, strict=True)) for v in model["vectors"]]
        near = sorted(range(len(dots)), key=lambda k: (-dots[k], k))[: quality_knn.NEIGHBOURS]
        weights = [max(dots[k], 0) ** quality_knn.SHARPNESS for k in near]
        want = sum(w * int(model["labels"][k]) for w, k in zip(weights, near, strict=True)) / sum(weights) if sum(weights) and t.strip() else model["labels"].mean()
        assert abs(quality_knn.vote(model, [t.encode()])[0] - want) < 1e-9
    assert quality_knn.scored(make_docs([]), labels).count() == 0


def test_shapes_by_hand():
    """Three-byte shapes of a text and the blank behind it, whatever text follows."""
    shape = lambda b: bytes(int(quality_knn.SHAPES[x]) for x in b + b"\n")
    texts = [b"Ab 1!", b"", b"x", "é\n\n".encode(), b"word word"]
    got = quality_knn.term_counts(texts)
    for row, t in zip(got, texts, strict=True):
        want = Counter(shape(t)[k : k + 3] for k in range(len(t) - 1))
        assert row[quality_knn.WORD_TERMS : quality_knn.WORD_TERMS + quality_knn.SHAPE_TERMS].sum() == sum(want.values())
        assert np.array_equal(row, quality_knn.term_counts([t])[0])


def test_toxicity(spark, make_docs, prose, monkeypatch):
    rnd = random.Random(4)

    def text(k):
        words = prose(k, 40).split()
        if k % 3 == 0:
            for _ in range(3):
                words.insert(rnd.randint(0, len(words)), "grumpf" + rnd.choice(["a", "ig", "el", "on", "ung", ""]))
        return " ".join(words)

    rows = [(k, text(k)) for k in range(300)] + [(1000 + i, t) for i, t in ODD]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    out = toxicity_gru.scored(make_docs(rows), labels).toPandas().set_index("doc_id")
    assert len(out) == len(rows) and out["score"].between(0, 1).all() and (out["score"][[1001, 1002, 1003]] == 0).all()
    held = [k for k in range(300) if out["held_out"][k]]
    assert held == [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([out["predicted"][k] == (k % 3 == 0) for k in held]) > 0.9
    assert toxicity_gru.scored(make_docs(rows), labels.where("toxic = 0")).toPandas()["score"].eq(0).all()
    assert toxicity_gru.scored(make_docs([]), labels).count() == 0
    assert {r.score for r in toxicity_gru.scored(make_docs(rows + rows), labels).where("doc_id = 3").collect()} == {out["score"][3]}


def test_gradients():
    """The network's gradients against finite differences."""
    toxicity = toxicity_gru
    texts = [b"one two three four five", b"six seven one", b"a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd ee ff gg hh ii jj"]
    x, p = toxicity.Merged(texts), {k: v.astype(np.float64) for k, v in toxicity.new_parameters(3).items()}
    which, labels, weights = np.arange(len(x.text)), np.array([1.0, 0.0, 1.0, 0.0])[: len(x.text)], np.ones(len(x.text))

    def loss():
        logit, _ = toxicity.forward(p, toxicity.embedded(p, x), x.windows, x.sizes)
        return float(np.mean(np.log1p(np.exp(-np.where(labels == 1, logit, -logit)))))

    g = toxicity.gradients(p, x, which, labels, weights)
    for name in ("in", "back_f", "back_b", "attend", "focus", "out", "in_bias"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        old, eps = p[name][at], 1e-2
        p[name][at] = old + eps
        up = loss()
        p[name][at] = old - eps
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 0.05 * abs(g[name][at]) + 1e-4


def test_forward_by_hand():
    """The network word by word in plain loops, characters and all."""
    t, rng = toxicity_gru, np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in t.new_parameters(5).items()}
    p["in_bias"] += rng.standard_normal(p["in_bias"].shape)
    p["attend_bias"] += 0.3
    texts = ["Größe überall", "one two, three: four " * 11, "ab", "naïvely 日本語の文章 x"]
    hash64 = lambda data, kind: int(t.mix(np.array([(sum(int(hashing.BYTE_CODES[c]) * pow(int(hashing.BASE), k, 1 << 64) for k, c in enumerate(data)) + kind) & (1 << 64) - 1], np.uint64))[0])
    sig = lambda v: 1 / (1 + np.exp(-v))

    def row(word):
        low = bytes(c | 32 if 65 <= c <= 90 else c for c in word.encode()).decode()
        out = p["word"][hash64(low.encode(), 0) % t.WORD_ROWS].copy()
        for n in t.BEGINNINGS:
            out += p["gram"][hash64(low[:n].encode(), n) % t.GRAM_ROWS]
        for n in t.ENDINGS:
            out += p["gram"][hash64(low[-n:].encode(), 100 + n) % t.GRAM_ROWS]
        inner = [low[k : k + t.INNER] for k in range(len(low) - t.INNER + 1)]
        return out + sum(p["gram"][hash64(g.encode(), 200) % t.GRAM_ROWS] for g in inner) / len(inner) if inner else out

    def states(rows, back, gates):
        h, out = np.zeros(t.HIDDEN), []
        for r in rows:
            x, y = (r @ p["in"] + p["in_bias"])[gates : gates + 3 * t.HIDDEN], h @ back
            z, reset = sig(x[: t.HIDDEN] + y[: t.HIDDEN]), sig(x[t.HIDDEN : 2 * t.HIDDEN] + y[t.HIDDEN : 2 * t.HIDDEN])
            h = z * h + (1 - z) * np.tanh(x[2 * t.HIDDEN :] + reset * y[2 * t.HIDDEN :])
            out.append(h)
        return out

    want = []
    for text in texts:
        words = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text)
        best = -np.inf
        for k in range(max(1, -(-(len(words) - t.WINDOW) // t.STRIDE) + 1)):
            rows = [row(w) for w in words[k * t.STRIDE : k * t.STRIDE + t.WINDOW]]
            both = [np.concatenate(s) for s in zip(states(rows, p["back_f"], 0), states(rows[::-1], p["back_b"], 3 * t.HIDDEN)[::-1], strict=True)]
            focus = np.array([np.tanh(s @ p["attend"] + p["attend_bias"]) @ p["focus"] for s in both])
            weight = np.exp(focus) / np.exp(focus).sum()
            best = max(best, sum(w * s for w, s in zip(weight, both, strict=True)) @ p["out"] + p["out_bias"][0])
        want.append(best)
    got = t.text_logits(p, t.Inputs([x.encode() for x in texts]), len(texts))
    assert np.allclose(got, want, atol=1e-4)


def test_main_text(spark):
    page = lambda k, body: f"<!DOCTYPE html><html><head><title>t{k}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li>News</li></ul></nav><div class=\"promo-x\">Buy now</div>{body}<div class='comments'><p>nice {k}</p></div><footer>&copy; site {k}</footer></body></html>"
    rows = [(k, f"http://h{k % 2}.org/{k}", page(k, f"<article><h1>Head {k} &amp; more</h1><p>First\n  <b>bold{k}</b>.<br>next<p>Second &lt;{k}&gt;<form><input>name</form></article>")) for k in range(12)]
    rows += [(50, None, None), (51, "x", ""), (52, "http://one.org/", page(52, "<div><p>No article here, but text.</p></div>")), (53, "http://one.org/", "plain < text & more")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in style_tree.main_texts(pages).collect()}
    assert len(out) == len(rows)
    for k in range(12):
        assert out[k].text == f"Head {k} & more First bold{k}. next Second <{k}>" and out[k].n_chars == len(out[k].text)
    assert out[50].text == out[51].text == "" and out[52].text == "No article here, but text." and out[53].text == "plain < text & more"
    assert style_tree.main_texts(pages.limit(0)).count() == 0


def tree_by_hand(rows):
    """host -> paths that go, from plain dictionaries: the definition in the module's docstring, page by page."""
    pages, slots, of = [], Counter(), {}
    for _, url, source in rows:
        page = style_tree.Page(source or "")
        article, least = style_tree.sketch(page)
        host = (url or "").partition("://")[2].split("/")[0].lower()
        pages.append((host, article, tuple(least), page))
        slots.update((host, article, s) for s in least)
    k, m, shapes, weigh = Counter(), Counter(), Counter(), lambda c, n: sorted(c, reverse=True)[n - 1]
    for host, article, least, page in pages:
        part = 1 / weigh([slots[host, article, s] for s in least], style_tree.ALIKE if article else style_tree.ALIKE_WHOLE)
        for path, inner, codes in style_tree.nodes(page):
            for h in (host, "*"):
                m[h, path, inner] += part
                for c in codes:
                    k[h, path, inner, c] += part
    ln, size = lambda x: math.log(max(x, 1)), lambda x: math.log(max(x, 2))
    for (h, path, inner, _), n in k.items():
        if inner:
            shapes[h, path] += n * math.log(n)
    of = {}
    for h, path, inner, c in k:
        if h != "*" and not inner:
            of.setdefault((h, path), []).append(c)
    gone = {}
    for (h, path), codes in of.items():
        bound = style_tree.LOW_IN_ARTICLE if re.search(r"/(article|main)([./]|$)", path) else style_tree.LOW
        above = path.rpartition("/")[0]
        for where in (h, "*"):
            n = m[where, path, False]
            content = 1.0 if n <= 1 else 1 - sum(ln(k[where, path, False, c]) for c in codes) / len(codes) / size(n)
            up = m[where, above, True]
            shape = 1.0 if up <= 1 else min(1.0, (math.log(up) - shapes[where, above] / up) / size(up))
            if n >= style_tree.MIN_PAGES and style_tree.CONTENT_SHARE * content + (1 - style_tree.CONTENT_SHARE) * shape < bound:
                gone.setdefault(h, set()).add(path)
    return gone


def test_style_tree_by_hand(spark, prose):
    """The removed branches against plain dictionaries; class names are random, so entropy alone can tell."""
    rnd, rows = random.Random(6), []
    notes = [prose(5000 + k, 6) + "." for k in range(8)]
    for k in range(160):
        h = k % 7
        menu = "".join(f"<li>{w}</li>" for w in rnd.sample(["Zim", "Zam", "Zum", "Zom", "Zem"], 3))
        body = f"<div class=q{h}x><ul>{menu}</ul></div><div class=k{h}y>{rnd.choice(notes)}</div><div class=v{h}z><h1>{prose(k, 4)}</h1><p>{prose(k + 300, 40)}.<p>{prose(k + 600, 30)}.</div><p class=w{h}>by q{h}</p>"
        rows.append((k, f"http://h{h}.org/{k}", f"<html><head><title>t</title><body>{body}</body></html>"))
    rows += [(200 + k, "http://h1.org/same", rows[1][2]) for k in range(40)] + [(300, None, None), (301, "x", ""), (302, "http://long.org/", "<p>" + prose(1, 30_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    named = pages.selectExpr("page_id", "coalesce(regexp_extract(url, '://([^/]*)', 1), '') AS host", "coalesce(html, '') AS html")
    got = {r.host: set(r.low) for r in style_tree.low_branches(named).collect()}
    assert got == tree_by_hand(rows)
    for r in style_tree.main_texts(pages).collect():
        if r.page_id < 160:
            k = r.page_id
            assert r.text == f"{prose(k, 4)} {prose(k + 300, 40)}. {prose(k + 600, 30)}."
        if r.page_id == 302:
            assert r.text == prose(1, 30_000)


def test_main_text_shuffled(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}.org/", f"<div>Menu</div><article><p>Text {k}.</p></article>") for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = sorted(style_tree.main_texts(pages).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(style_tree.main_texts(pages).collect()) == one and one[0].text == "Text 0."
    twice = style_tree.main_texts(pages.unionByName(pages)).collect()
    assert sorted(twice) == sorted(one * 2)


@pytest.mark.parametrize(
    "source, want",
    [
        ("<html><head><meta charset=x><title>t</title><body><p>Text.", "Text."),
        ("<article><p>One.</p><div class='related-work'>Two.</div><div class=notice>Three.</div><div class='ad'>No.</div></article>", "One. Two. Three."),
        ("<p>One.</p><style-x>Two.</style-x><p>Three.</p>", "One. Two. Three."),
        ("<p class='hidden x'>One.</p><p hidden>No.</p><p style='display: none'>No.</p><p data-class=nav>Two.</p>", "One. Two."),
        ("<p>One.<button>Two.<p>Three.", "One.Two. Three."),
        ("<p>One.<button>No.</button><p>Three.<script>var a = 1", "One. Three."),
    ],
)
def test_no_text_lost(source, want):
    assert style_tree.main_text(style_tree.Page(source), set()) == want


def test_entropy_alone(spark):
    """On the driver's pages the trees alone remove what the markup names as furniture."""
    from support import DATA

    pages = spark.read.parquet(f"{DATA.rsplit('/', 1)[0]}/sf0.01/pages.parquet")
    named = pages.select("page_id", style_tree.url_parts(pages["url"])[0].alias("host"), "html")
    low = {r.host: set(r.low) for r in style_tree.low_branches(named).collect()}
    with_names = {r.page_id: r.text for r in style_tree.main_texts(pages).collect()}
    same = [style_tree.main_text(style_tree.Page(r.html or ""), low.get(r.host, set()), names=False) == with_names[r.page_id] for r in named.collect()]
    assert np.mean(same) > 0.9  # the others are of hosts with a page or two


@pytest.mark.parametrize("tag", ["article", "div"])
def test_main_text_of_copies(spark, prose, tag):
    """1,000 copies and 1,000 near copies of one article keep their text; a menu of many unlike pages does not."""
    body = lambda head, text: f"<body><div>Home News About</div><{tag} class=x><h1>{head}</h1><p>{text}</p></{tag}></body>"
    text, menu = prose(1, 200), "Home News About "
    near = [" ".join(w if i != 7 * (k % 28) else f"edit{k}" for i, w in enumerate(text.split())) for k in range(1000)]
    rows = [(k, f"http://copies.org/{k}", body("One head", text)) for k in range(1000)]
    rows += [(1000 + k, f"http://near.org/{k}", body("One head", near[k])) for k in range(1000)]
    rows += [(2000 + k, f"http://unlike.org/{k}", body(f"Head {k}", prose(100 + k, 60))) for k in range(200)]
    out = {r.page_id: r.text for r in style_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    assert all(out[k].removeprefix(menu) == f"One head {text}" for k in range(1000))
    assert all(out[1000 + k].removeprefix(menu) == f"One head {near[k]}" for k in range(1000))
    assert all(out[2000 + k] == f"Head {k} {prose(100 + k, 60)}" for k in range(200))


@pytest.mark.parametrize(("folder", "recall"), [("sf0.01", 0.5), ("sf0.1", 0.9)])
def test_toxic_recall_on_driver_tables(spark, folder, recall):
    """Held-out labelled documents, with few and with more labels to learn from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity_gru.scored(docs, labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    found = out["predicted"] == 1
    assert (found & (out["toxic"] == 1)).sum() > recall * (out["toxic"] == 1).sum()
    assert (out["toxic"][found] == 1).mean() > 0.7
