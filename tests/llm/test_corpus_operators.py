"""Duplicates, decontamination, language model, archives, tool calls, and the pipeline: operators over whole tables."""

import hashlib
import itertools
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_text_operators import ODD, ODD_SCHEMA
from tidyveil.llm import decontaminate, exact, graph, pitman_yor, simhash, toolcalls, warc

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_cut_places():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 300_000).astype(np.uint8)
    ends = exact.cut_places(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= exact.MOST and sizes[:-1].min() >= exact.LEAST
    moved = exact.cut_places(np.concatenate([data[:100], data]))  # cuts find back to the content
    assert len({e - 100 for e in moved} & set(ends)) > 0.8 * len(ends)
    assert exact.cut_places(data[:0]) == [] and exact.cut_places(np.zeros(40_000, np.uint8))[-1] == 40_000


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    """Also where digests clash, as they do all the time when they have a few bits."""
    rng = random.Random(1)
    long = "".join(rng.choice("abcdef ") for _ in range(30_000))
    texts = [None, "", "a", "a", "A", "b ", "b", long, long, long[:-1] + "!", "!" + long[1:], "c" * 9000, "c" * 9000]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(3, "a", "k", 1), (None, "a", "k", 1), (None, "lone", "k", 1), (None, "lone", "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, recipe string, kept int")
    digest = (lambda c: F.unhex(F.substring(F.md5(c), 1, 1))) if weak else exact._digest
    found = Counter((r["id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["text_sha256"]).hex()) for r in exact.exact_groups(df, digest=digest).collect())
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(ids):
            want[i, keep, len(ids), i == keep and k == ids.index(i), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert found == want
    kept = exact.drop_copies(df).collect()
    assert sorted(r["text"] or "" for r in kept) == sorted(groups) and kept[0].__fields__ == df.columns
    assert exact.exact_groups(df.limit(0)).collect() == []


def test_golay_keys():
    rng = np.random.default_rng(1)
    one = rng.integers(-(2**63), 2**63 - 1, 3000)
    other = one.view(np.uint64).copy()
    for _ in range(3):
        other ^= np.uint64(1) << rng.integers(0, 64, len(one)).astype(np.uint64)
    shared = np.zeros(len(one), bool)
    for (a, p), (b, q) in zip(simhash.keys_of(one), simhash.keys_of(other.view(np.int64))):
        place, back = {v: k for k, v in enumerate(one.tolist())}, {v: k for k, v in enumerate(other.view(np.int64).tolist())}
        both = {(k, place[f]) for k, f in zip(a.tolist(), p.tolist())} & {(k, back[f]) for k, f in zip(b.tolist(), q.tolist())}
        shared[[k for _, k in both]] = True
    assert shared.all()


def _fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", _lower(text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_near_groups(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(400)]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(400)] = rng.choice(words)
            docs.append(" ".join(text) + rng.choice(["", "\n", " "]))
    docs += [None, "", " \x0b", "one", "One", "two words", "É É é"]
    rng.shuffle(docs)
    rows = [(i, t, "x", "y") for i, t in enumerate(docs)] + [(5, docs[5], "x", "y"), (None, docs[6], "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id string")
    prints = [_fingerprint(t) for t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = _roots(len(docs), links)
    found = simhash.groups_by_document(df).collect()
    assert len(found) == len(rows) and len(set(want)) < 40
    for r in found:
        i = 6 if r["doc_id"] is None else r["doc_id"]
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[i]:016x}", want[i])
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} - {None} == set(want)
    assert simhash.groups_by_document(df.limit(0)).collect() == []


def test_long_runs_of_a_key_are_compared_in_blocks():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    fps = np.unique(np.concatenate([[x ^ (1 << int(b)) for b in rng.integers(0, 60, 5)] for x in rng.integers(0, 2**62, 30).tolist()]))
    key = np.sort(rng.integers(0, 3, len(fps)))
    for size, most in ((7, 4), (1000, 4), (3, 1000)):
        batches = (pa.RecordBatch.from_arrays([pa.array(key[k : k + size]), pa.array(fps[k : k + size])], names=["key", "fp"]) for k in range(0, len(fps), size))
        links, blocks = [], {}
        for batch in simhash._link_runs(batches, most):
            for r in batch.to_pylist():
                links += [(r["a"], r["b"])] if r["a"] is not None else []
                blocks.setdefault(r["key"], []).append(np.array(r["fps"])) if r["fps"] else None
        for own in blocks.values():
            for j, right in enumerate(own):
                for i, left in enumerate(own[: j + 1]):
                    links += simhash.spanning_links(left, None if i == j else right)
        at = {v: k for k, v in enumerate(fps.tolist())}
        near = [(i, j) for i in range(len(fps)) for j in range(i) if key[i] == key[j] and int(fps[i] ^ fps[j]).bit_count() <= 3]
        assert _roots(len(fps), [(at[a], at[b]) for a, b in links]) == _roots(len(fps), near)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(-5, 100), (7, 7)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(2, 41)} | {k: -5 for k in range(100, 130)}


def test_passages(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "the of and bron clar dux é".split() for b in range(9)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(f"i{k}", " ".join(make(rng.choice([3, 9, 10, 14, 40])))) for k in range(25)] + [("short", "Zyx"), ("none", " ,. "), ("null", None), (None, "bron1 " * 12)]
    items += [items[0], ("twin", items[1][1].upper() + "!")]
    docs = []
    for k in range(60):
        text = make(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            part = (rng.choice(items)[1] or "").split()
            cut = rng.randint(0, max(0, len(part) - 10))
            text[rng.randint(0, len(text)) :] = part[cut : cut + rng.choice([9, 10, 11, 40])]
        docs.append((k, rng.choice([" ", ", ", "-\n"]).join(text)))
    docs += [(100, None), (101, ""), (102, items[5][1]), (102, items[5][1]), (None, items[6][1]), (103, "zyx " * 30_000)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t or ""))
    windows = [(i, tuple(w[k : k + min(10, len(w))])) for i, t in items if i is not None for w in [split(t)] if w for k in range(max(1, len(w) - 9))]
    want = Counter()
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for item, window in windows:
            for k in range(len(w) - len(window) + 1):
                if w[k] == window[0] and tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found.add(item)
        want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id string, text string, doc_id int")
    assert Counter(map(tuple, decontaminate.passages_by_document(df, bench).collect())) == want
    kept = decontaminate.without_passages(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(n for w, n in want.items() if not w[5])
    assert decontaminate.passages_by_document(df.limit(0), bench).collect() == []
    assert all(r["n_hit"] == 0 for r in decontaminate.passages_by_document(df, bench.limit(0)).collect())


def test_language_model(spark, documents):
    rows = [(r["doc_id"] + 1000, r["text"], "x") for r in documents.select("doc_id", "text").collect()] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", _lower(t or "")) if w] + [""]
    counts = Counter(w for i, t, _ in rows if not out(i) for w in tokens(t))
    total = sum(counts.values())
    found = pitman_yor.scores_by_document(df).collect()
    assert len(found) == len(rows)
    texts = {i: t for i, t, _ in rows}
    sums = np.zeros(4)
    for r in found:
        own = tokens(texts[r["doc_id"]])
        base = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(r["doc_id"]), len(own), sum(counts[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
        sums += [r["base_score"], r["score"], 0, 0] if not r["held_out"] else [0, 0, r["base_score"], r["score"]]
    assert sums[1] > sums[0] and sums[3] > sums[2]  # better than shares of words, on both
    assert pitman_yor.scores_by_document(df.limit(0)).collect() == []
    alone = pitman_yor.scores_by_document(df.filter("doc_id = 0 AND false OR doc_id IS NULL")).collect()  # nothing to learn from
    assert [(r["train_tokens"], r["n_known"]) for r in alone] == [(0, 0)]


def test_predictive_probabilities_sum_to_one(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice("a bb ccc dd e ff gg".split()) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    model = pitman_yor.train(spark.createDataFrame(texts, "doc_id long, text string"))
    codes = pitman_yor._Codes()
    words = ["a", "bb", "ccc", "dd", "e", "ff", "gg", "", "neverseen"]
    keys = np.array(sorted(np.uint64(codes[w.encode()]) & pitman_yor._WORD for w in words), np.uint64)
    table, _ = pitman_yor._lookup(model, keys)
    assert (10.0 ** table.astype(float)).sum(axis=0) == pytest.approx(np.ones(pitman_yor.CONTEXTS), abs=1e-5)


def test_contexts_are_whole_words(spark, monkeypatch):
    """Words of one ending have restaurants of their own, whose totals lie in other buckets or only at their homes."""
    rng, follows = random.Random(11), {"raining": "cats", "training": "dogs"}
    texts = [(i, " ".join(x for w in rng.choices([*follows], k=20) for x in (w, follows[w]))) for i in range(40)]
    model = pitman_yor.train(spark.createDataFrame(texts, "doc_id long, text string"))
    codes, known = pitman_yor._Codes(), ["", "cats", "dogs", "raining", "training"]
    words = sorted([*known, "gaining"], key=lambda w: codes[w.encode()])
    contexts, totals = pitman_yor._commonest(model)
    table, _ = pitman_yor._lookup(model, np.array([codes[w.encode()] for w in words], np.uint64), (contexts, totals))
    column = {w: contexts.tolist().index(codes.contexts[codes[w.encode()]]) for w in known}
    log = lambda w, x: float(table[words.index(x), column[w]])
    assert log("raining", "cats") > log("training", "cats") + 1 and log("training", "dogs") > log("raining", "dogs") + 1
    monkeypatch.setattr(pitman_yor, "FREQUENT", 2.0)  # no word is frequent, so all tokens go to buckets
    asked = ["", *(" ".join(w) for n in (1, 2) for w in itertools.product(words, repeat=n) if "" not in w), "raining dogs cats training raining"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    found = {asked[r["id"]]: r["score"] for r in pitman_yor.score(docs, model).collect()}
    for text, score in found.items():
        own = ["", *text.split(), ""]
        if "gaining" not in own[1:-1]:
            assert score == pytest.approx(sum(log(w, x) for w, x in zip(own, own[1:])), abs=1e-4), text
    # After a word never seen, what is seen after its ending: probabilities of all words and of one unknown.
    first = log("", "gaining")
    after = {x: found[f"gaining {x}"] - first - log(x, "") for x in known if x} | {"": found["gaining"] - first}
    after["gaining"] = found["gaining gaining"] - first - after[""]
    assert sum(10**v for v in after.values()) == pytest.approx(1, abs=1e-4)
    assert after["cats"] > table[words.index("cats"), -1] and after["raining"] < table[words.index("raining"), -1]  # than in a context never seen


def test_no_sweep_is_sampled_again(spark):
    """The stored states are those of sweeps from the start, each with the totals of the one before."""
    rng = random.Random(5)
    texts = [(i, " ".join(f"{rng.choice('abc')}{int(rng.expovariate(0.1))}" for _ in range(50))) for i in range(60)]
    model = pitman_yor.train(spark.createDataFrame(texts, "doc_id long, text string"))
    rounds, tables = len(model.rounds), 0
    assert [r.filter("kind = 2").count() > 0 for r in model.rounds] == [False] + [True] * (rounds - 1)
    batches = pitman_yor._to_buckets(model.rows, model.rounds, model.buckets).toArrow().to_batches()
    for own, states, totals, row in pitman_yor._by_bucket(iter(batches), model.buckets, rounds):
        assert row is None and len(states) == len(totals) == rounds
        state = own.start()
        for k in range(rounds):
            state = own.sweep(model.settings, state, totals[k - 1], k - 1) if k else state
            assert all(np.array_equal(x, y) for x, y in zip(state, states[k], strict=True))
        tables += sum(state[0] > 1)
    assert tables > 0


def test_tokens_of_a_block():
    rng = random.Random(4)
    odd = [b"", b" ", b"a", b"\x00 \x0eB\x1f\x85 \xc2\xa0x\t\n\x0b\x0c\rA", b"end", b"begin ", " É a".encode(), b"w" * 70_000, b""]
    odd += [bytes(rng.choices(b" \t\nabAB\xc3\xa9\x00\x1c", k=rng.randrange(9))) for _ in range(2000)]
    codes = pitman_yor._Codes()
    for texts in (pa.array(odd, pa.binary()), pa.array(odd, pa.binary()).slice(3, 4), pa.array([b"", b""], pa.binary()), pa.array([b"x"], pa.large_binary())):
        plain = [[*text.as_py().lower().split(), b""] for text in texts]
        words = [w for own in plain for w in own]
        found, contexts, key, row = pitman_yor._tokens(texts)
        assert row.tolist() == [k for k, own in enumerate(plain) for _ in own]
        assert found[key >> 32].tolist() == [codes[w] for w in words]
        assert contexts[key & 0xFFFFFFFF].tolist() == [codes.contexts[codes[w]] for w in [words[-1], *words[:-1]]]
    text = [" ".join(rng.choices(["the", "cat", "sat", "on", "mat"], k=400)).encode() for _ in range(400)]
    made = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pitman_yor.xxhash, "xxh64_intdigest", lambda w, own=xxhash.xxh64_intdigest: made.append(w) or own(w))
        pitman_yor._tokens(pa.array(text, pa.binary()))
    assert sorted(made) == [b"", b"cat", b"mat", b"on", b"sat", b"the"]
    words, sizes = pitman_yor._words(pa.array(text, pa.binary()))
    assert words.to_pylist() == [w for t in text for w in [*t.split(), b""]] and sizes.tolist() == [401] * 400


def test_blocks_grow_with_buckets(monkeypatch):
    monkeypatch.setattr(pitman_yor, "BLOCK", 1000)
    texts = [b"x" * n for n in [100] * 200 + [5000, 0, 10]]
    batches = pa.Table.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["id", "body"]).to_batches(max_chunksize=7)
    found = {b: list(pitman_yor._blocks(iter(batches), b)) for b in (8, 128, 100_000)}
    for own in found.values():
        assert [i for x in own for i in x.column(0).to_pylist()] == list(range(len(texts))) and [t for x in own for t in x.column(1).to_pylist()] == texts
    assert len(found[8]) > 1.5 * len(found[128]) > 2 * len(found[100_000]) > 0
    assert max(sum(map(len, x.column(1).to_pylist())) for x in found[100_000] if x.num_rows > 2) <= 4000  # not without end
    assert list(pitman_yor._blocks(iter([]), 8)) == []


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
def test_places_in_sorted_keys(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    wanted = np.concatenate([keys, keys + np.uint64(1), np.array([0, 1, 2**64 - 1], np.uint64)])
    at, there = pitman_yor._found(keys, wanted)
    assert there.tolist() == np.isin(wanted, keys).tolist() and (keys[at[there]] == wanted[there]).all()


def test_pairs_of_blocks_are_merged():
    rng = np.random.default_rng(9)
    parts, want = [], Counter()
    for n in (1, 500, 2000):
        words, contexts = np.sort(rng.choice(10**6, 40, replace=False) * 9 % 60).astype(np.uint64), np.arange(5, 305, 3, dtype=np.uint64) << np.uint64(38)
        words = np.unique(words)
        key, counts = np.unique(rng.integers(len(words), size=n) << 32 | rng.integers(len(contexts), size=n), return_counts=True)
        words, of = words[np.unique(key >> 32)], np.unique(key >> 32, return_inverse=True)[1]
        own, at = np.unique(key & 0xFFFFFFFF, return_inverse=True)
        parts.append((words, np.bincount(of), counts.astype(np.uint64), contexts[own], at.astype(np.uint32)))
        for w, c, k in zip(words[of].tolist(), contexts[own][at].tolist(), counts.tolist()):
            want[w, c] += k
    words, sizes, counts, contexts, at = pitman_yor._merged(parts)
    pairs = list(zip(np.repeat(words, sizes).tolist(), contexts[at].tolist()))
    assert pairs == sorted(want) and dict(zip(pairs, counts.tolist())) == dict(want)
    bucket = pitman_yor.Bucket(0, words, sizes, counts, contexts, at, 3)
    endings = contexts | np.uint64(pitman_yor._ENDING)
    assert bucket.rooms.tolist() == sorted({*contexts.tolist(), *endings.tolist()})
    assert bucket.rooms[bucket.room].tolist() == [c for _, c in pairs]
    assert list(zip(words[bucket.word].tolist(), bucket.rooms[bucket.ending].tolist())) == sorted({(w, c | pitman_yor._ENDING) for w, c in pairs})


def test_words_are_hashed_all_at_once():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcxyz019é", k=rng.randint(1, 12))).encode() for _ in range(300_000)] + [b"long" * 400_000, b"a", b"ab", b"ba"]
    texts = [b" -".join(words[:1000]), b"", b"end", b"begin, " + b". ".join(words[1000:]), b"", b"x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["id", "body"])
    want = [(k, w) for k, text in enumerate(texts) for w in decontaminate.words_of(text)]
    own = []
    began = time.process_time()
    found = list(decontaminate._parsed(iter([batch]), decontaminate._Hashes()))
    spent = time.process_time() - began
    for part, w in found:
        own += [(part.column(0)[int(k)].as_py(), w.folded[a:b], h) for k, a, b, h in zip(w.owner, w.starts, w.ends, w.hashes.tolist())]
    assert [(k, w) for k, w, _ in own] == want
    assert len({h for *_, h in own}) == len({w for _, w in want}) == len({(w, h) for _, w, h in own})
    began = time.process_time()
    known = {w: xxhash.xxh64_intdigest(w) for text in texts for w in decontaminate.words_of(text)}
    assert spent < time.process_time() - began and known  # no step in Python for each word


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, version):
    big, small = "<p>é\r\n\r\nWARC/1.1\n" * 40, "x" * 99
    pages = [(5, "http://a/b c", big), (3, "http://é", big), (9, None, big + "!"), (7, "u", small), (8, "u", small), (1, "u", None), (2, "u", ""), (None, "u", big), (4, "u", "y" * 300_000)]
    pages += [(6, "u", "again" * 30), (6, "u", "again" * 30)]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, payload_digest string")
    rows = warc.records_by_page(df, version).collect()
    want = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        first = {big: 3, "again" * 30: 6}.get(html, i)
        want[i, len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first] += 1
    twin = (6, 150, hashlib.sha256(b"again" * 30).hexdigest())
    want[(*twin, "response", None)] -= 1
    want[(*twin, "revisit", 6)] += 1
    assert Counter(map(tuple, rows)) == want
    assert warc.records_by_page(df.limit(0), version).collect() == []


def test_arc_headers():
    block = b"1 0 org\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://x 0.0.0.0 20010203 text/plain %d\n" % len(block) + block + b"\nhttp://a b/ 1.2.3.4 2001 text/html 3\nxyz\ndns:a 1.2.3.4 20010203040506 text/dns 0\n\n"
    assert [(f["URL"], body) for _, f, body in warc.arc_records(data)] == [("http://a b/", b"xyz"), ("dns:a", b"")]
    for bad in (data[:-20], data.replace(b"1 0 org", b"3 0 org"), b"http://a 1 2 t 1\nx"):
        with pytest.raises(ValueError):
            list(warc.arc_records(bad))


def test_tool_calls(spark):
    call = lambda *calls: json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "needs"), c)) for c in calls]})
    result = lambda i, content: json.dumps({"tool_call_id": i, "content": content})
    good, bad = '{"text": "é\\n", "limit": 3}', '{"limit": "3", "other": 1.50}'
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("a", "reply", good, []), ("b", "reply", bad, ["a"]))), (1, 2, "tool", result("a", "r1")), (1, 2, "tool", result("zz", "r2")),
        (1, 3, "assistant", call(("a", "reply", good, ["b", "nope"]), ("c", "reply", "no json", ["d"]), ("d", "unknown", good, ["c"]))), (1, 4, "tool", result("a", "late")),
        (1, 0, "tool", result("c", "too early")), (1, 1, "tool", result("a", "too early")), (2, 0, "assistant", "plain"), (2, 1, "assistant", None), (2, 2, "assistant", "{broken"), (2, 3, "tool", "{}"), (2, 4, "assistant", call((None, "summarize", '{"text":"t","ratio":1}', None))),
        (None, 1, "assistant", call(("a", "reply", good, []))), (3, 1, "assistant", call(("a", "reply", good, ["b"]))), (3, 2, "assistant", call(("b", "reply", good, []))),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, state string")
    linked = sorted(toolcalls.link_tool_calls(df, toolcalls.SCHEMAS).collect(), key=lambda r: r["state"] != "orphan")
    found = {(r["conv"], r["turn"], r["position"], r["call_id"]): r for r in linked}
    state = {k: (r["state"], list(r["problems"]), r["result_turn"]) for k, r in found.items()}
    state["twice"] = sum(r["conv"] == 1 and r["turn"] == 1 and r["call_id"] == "a" for r in linked)
    assert state == {
        (1, 1, 0, "a"): ("answered", [], 2), (1, 1, 1, "b"): ("unanswered", ["limit is not integer", "missing text", "undeclared other"], None),
        (1, 3, 0, "a"): ("repeated", ["needs unknown"], None), (1, 3, 1, "c"): ("unanswered", ["arguments are no object", "in a cycle"], None),
        (1, 3, 2, "d"): ("unanswered", ["unknown tool unknown", "in a cycle"], None), (1, 2, 0, "zz"): ("orphan", [], 2), (1, 4, 0, "a"): ("orphan", [], 4), (1, 0, 0, "c"): ("orphan", [], 0), "twice": 2,
        (2, 3, 0, None): ("orphan", [], 3), (2, 4, 0, None): ("unanswered", [], None), (None, 1, 0, "a"): ("unanswered", [], None),
        (3, 1, 0, "a"): ("unanswered", [], None), (3, 2, 0, "b"): ("unanswered", [], None),
    }
    assert found[1, 1, 0, "a"]["canonical"] == '{"arguments":{"limit":3,"text":"é\\n"},"content":"r1","id":"a","name":"reply","state":"answered"}'
    assert all(json.loads(r["canonical"]) for r in found.values())
    order = {k: (r["at_turn"], r["at_position"], r["level"]) for k, r in found.items()}
    assert order[3, 1, 0, "a"] == (2, 0, 1) and order[3, 2, 0, "b"] == (2, 0, 0) and order[1, 3, 1, "c"][2] is None and order[1, 1, 1, "b"] == (1, 1, 0)
    assert toolcalls.link_tool_calls(df.limit(0), toolcalls.SCHEMAS).collect() == []


def test_calls_come_in_topological_order(spark):
    """Random needs in both directions, one conversation far larger than the others, circles, and a long chain against the order."""
    rng, rows, needs = random.Random(2), [], {}
    for conv in range(12):
        turns = 40 if conv == 0 else 6
        ids = [(t, p) for t in range(turns) for p in range(rng.randrange(1, 4))]
        for t in range(turns):
            calls = []
            for node in (i for i in ids if i[0] == t):
                wanted = [rng.choice(ids) for _ in range(rng.choice([0, 0, 1, 1, 2]))] if conv % 3 else [i for i in [(t - 1, 0)] if t and rng.random() < 0.9]
                if conv % 4 == 1:  # needs point forwards only
                    wanted = [w for w in wanted if w > node]
                needs[conv, *node] = set(wanted)
                calls.append({"id": "%d.%d" % node, "name": "look_up", "arguments": '{"turn":1}', "needs": ["%d.%d" % w for w in wanted]})
            rows.append((conv, t, "assistant", json.dumps({"tool_calls": calls})))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r["conv"], r["turn"], r["position"]): r for r in toolcalls.link_tool_calls(df, toolcalls.SCHEMAS).collect()}
    assert set(found) == set(needs)

    def closure(node):
        seen, todo = set(), [node]
        while todo:
            for w in needs[todo.pop()]:
                if (node[0], *w) not in seen:
                    seen.add((node[0], *w))
                    todo.append((node[0], *w))
        return seen

    reach = {n: closure(n) for n in needs}
    place = {n: max([n[1:], *(m[1:] for m in reach[n])]) for n in needs}
    for n, r in found.items():
        assert (r["at_turn"], r["at_position"]) == place[n]
        stuck = any(m in reach[m] and place[m] == place[n] for m in [n, *reach[n]])
        assert (r["level"] is None) == stuck == ("in a cycle" in r["problems"])
        if not stuck:
            for w in needs[n]:
                m = found[n[0], *w]
                assert (m["at_turn"], m["at_position"], m["level"] or 0) < (r["at_turn"], r["at_position"], r["level"]) or m["level"] is None
    assert sum(r["level"] is None for r in found.values()) > 5 and sum((r["level"] or 0) > 1 for r in found.values()) > 5


def test_near_copies_of_the_pipeline(spark):
    """One document of each group stays, as by comparing all fingerprints with each other."""
    import corpus_pipeline

    rng, rows = random.Random(3), [(900, None), (901, " ")]
    for k in range(30):
        first = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for m in range(5):
            words = list(first)
            for _ in range(m and rng.randrange(1, 3)):
                words[rng.randrange(400)] = f"x{rng.randrange(5000)}"
            rows.append((k * 10 + m, " ".join(words)))
    rows = [(i, t, "x") for i, t in rows]
    prints = {i: simhash.fingerprint_of((t or "").encode()) for i, t, _ in rows}
    group = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= 3 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = corpus_pipeline.without_near_copies(spark, df, "")
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == df.columns and kept == set(group.values()) and 31 < len(kept) < 120


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    docs, before = spark.read.parquet(f"{FOLDER}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        rows = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, FOLDER)
        kept = {r["doc_id"] for r in out.collect()}
        assert kept <= set(rows)
        if name == "exact_dedup":
            assert kept == {max(i for i, r in rows.items() if r["text"] == t) for t in {r["text"] for r in rows.values()}}
        if name == "byte_bpe":
            assert kept == set(rows)
        else:
            assert out.columns == docs.columns
            before = out
        docs = out
    assert corpus_pipeline.run(spark, FOLDER).count() == before.count() > 50
