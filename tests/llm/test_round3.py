"""Best-fit windows, periodic runs and the filter audit against brute force."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_operators import CLASHING, ROWS

from ridgeline.llm import audit, bestfit, chat, lines, neardup, registry, runs, similar
from ridgeline.llm.common import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def windows_by_force(counts, capacity):
    """The rooms that best-fit decreasing leaves, one piece at a time."""
    rooms = []
    for n in range(capacity, 0, -1):
        for _ in range(counts[n]):
            fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits)[1]] -= n
            else:
                rooms.append(capacity - n)
    return sorted(rooms)


def test_best_fit_plan():
    rng = random.Random(2)
    for _ in range(400):
        capacity = rng.choice([1, 7, 16, 33, 64])
        counts = np.zeros(capacity + 1, int)
        for _ in range(rng.randint(0, 60)):
            counts[rng.randint(1, capacity)] += rng.choice([1, 1, 5])
        plan, sequences = bestfit.plan_best_fit(counts, capacity)
        held = [[] for _ in range(sequences)]
        for n in range(1, capacity + 1):
            rows = sorted(r for r in plan.tolist() if r[0] == n)
            for rank in range(counts[n]):
                _, first, sequence, times, offset = [r for r in rows if r[1] <= rank][-1]
                held[sequence + (rank - first) // times].append((offset + (rank - first) % times * n, n))
        for pieces in held:
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in pieces) for pieces in held) == windows_by_force(counts, capacity)


def test_open_windows():
    rng = random.Random(3)
    opened, rooms = bestfit.OpenWindows(50), Counter()
    for _ in range(2000):
        if rng.random() < 0.5:
            room = rng.randint(1, 50)
            opened.put(room, 0, 1)
            rooms[room] += 1
        else:
            need = rng.randint(1, 50)
            room = opened.tightest(need)
            assert room == min((r for r in rooms if r >= need and rooms[r]), default=0)
            if room:
                opened.take(room)
                rooms[room] -= 1


@pytest.mark.parametrize("capacity", [16, 4096])
def test_best_fit(spark, capacity):
    from tokenizers import Tokenizer

    long = " ".join(f"word{i % 977} and" for i in range(9000))
    rows = [*((d, t) for d, t, *_ in ROWS), (50, long), (51, long), (50, "again")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, length string, offset int")
    got = [r.asDict() for r in bestfit.pack_best_fit(docs, WORDS, capacity=capacity).collect()]
    tokenizer = Tokenizer.from_file(WORDS)
    expected = Counter()
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for at in range(0, len(ids), capacity):
            piece = ids[at : at + capacity]
            expected[d, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    counts = np.bincount([r["length"] for r in got], minlength=capacity + 1)
    assert sorted(capacity - sum(n for _, n in p) for p in sequences.values()) == windows_by_force(counts, capacity)
    assert bestfit.pack_best_fit(docs.limit(0), WORDS).count() == 0


def test_best_fit_pads_little(spark):
    got = registry.op11_best_fit(spark, "/root/testdata/sf0.01").groupBy("sequence_id").agg({"length": "sum"}).collect()
    used = [r[1] for r in got]
    assert sum(4096 - n for n in used if n & (n - 1)) < 0.005 * sum(used)


def runs_by_force(words, least):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q) and all(any(words[i + k] != words[i + k + r] for k in range(size - r)) for r in range(1, q)):
                found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_words():
    rng = random.Random(1)
    for _ in range(1500):
        n, letters, least = rng.randint(0, 70), rng.choice([1, 2, 3, 6]), rng.choice([2, 4, 5, 12])
        words = [rng.randrange(letters) for _ in range(n)]
        if n > 20 and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 12)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        expected = runs_by_force(words, least)
        assert sorted(runs.runs_of(words, least), key=lambda r: (r[0], r[2])) == expected
        parts = runs.stretches(np.array(words, np.int64), np.array([0, n]), least)
        assert sorted(((x + s, k, q) for _, x, y in parts for s, k, q in runs.runs_of(words[x:y], least)), key=lambda r: (r[0], r[2])) == expected
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert sorted(runs.runs_of(list(fibonacci[-1]), 4), key=lambda r: (r[0], r[2])) == runs_by_force(list(fibonacci[-1]), 4)


def periodic(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def said_of_runs(doc_id, text):
    words = periodic(doc_id, text)
    found = runs_by_force(words, 12)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    said = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(said), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_runs(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["to", "be", "or", "nöt", "To"]) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    texts += ["ha " * 40, "\t\x0b".join("abc" * 9), "x\x1cy x y " * 12, "  " * 13, None, "", "  \n "]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, "again " * 13), (5, "again " * 13)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, runs int, collapsed string")
    got = runs.digests(runs.periodic_runs(runs.with_planted_repeats(docs))).select(RUN_COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(said_of_runs(*r) for r in rows)
    assert runs.digests(runs.periodic_runs(runs.with_planted_repeats(docs.limit(0)))).count() == 0
    plain = runs.periodic_runs(spark.createDataFrame([(1, "so " + "la la li " * 5 + "end")], "doc_id bigint, text string")).first()
    assert (plain["n_words"], plain["collapsed"]) == (17, "so la la li end") and [tuple(r) for r in plain["runs"]] == [(1, 15, 3)]


def test_periodic_runs_query(spark, sf_dir):
    short = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(WORD.findall(r[1] or "")) < 1500}
    got = [tuple(r) for r in registry.op12_periodic_runs(spark, sf_dir).select(RUN_COLUMNS).collect()]
    assert Counter(r for r in got if r[0] in short) == Counter(said_of_runs(*x) for x in short.items())
    assert len(short) > 150 and any(r[1] for r in got)


def test_long_periodic_text(spark):
    words = [f"w{i * i % 9973}" for i in range(9000)] * 6
    (row,) = runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")).collect()
    assert (0, 54000, 9000) in [tuple(r) for r in row["runs"]] and row["collapsed"] == " ".join(words[:9000])


def test_trie():
    rng = random.Random(4)
    for _ in range(200):
        trie, least = audit.RadixTrie(), {}
        for _ in range(60):
            text, doc = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))), rng.randint(-5, 30)
            least[text] = min(doc, least.get(text, doc))
            assert trie.insert(text, doc).least == least[text]
        assert sorted(n.least for n in trie.terminals) == sorted(least.values())
        assert trie.size <= sum(map(len, least))


def masks_by_force(rows):
    least = {}
    for d, _, t in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, part, t in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > least[t])
        out.append((d, part or "", sum(1 << k for k, x in enumerate(fails) if x)))
    return out


def audited_by_force(masks, good, toxic):
    out = []
    for part in {p for _, p, _ in masks}:
        mine, rows = [(d, m) for d, p, m in masks if p == part], []
        for order in itertools.permutations("ABCDE"):
            gone = 0
            for step, x in enumerate(order, 1):
                bit = 1 << "ABCDE".index(x)
                taken = [d for d, m in mine if not m & gone and m & bit]
                rows.append((x, (part, "".join(order), step, sum(not m & (gone | bit) for _, m in mine), len(taken), sum(bool(m & gone and m & bit) for _, m in mine), sum(m == bit for _, m in mine), sum(d in good for d in taken), sum(d in toxic for d in taken))))
                gone |= bit
        total = Counter()
        for x, r in rows:
            total[x] += r[4]
        out += [(*r, total[x]) for x, r in rows]
    return Counter(out)


@pytest.mark.parametrize("hot", [audit.HOT, 1])
def test_filter_audit(spark, hot, monkeypatch):
    rng = random.Random(6)
    copies = ["the same text", "", None, "Shouted TEXT", "with 5 % more", "y" * 5000 + "a", "y" * 5000 + "b", " ".join(f"w{i}" for i in range(250)), "a b " * 120]
    rows = [(rng.randint(0, 90) if rng.random() < 0.9 else None, rng.choice(["en", "de", "", None]), rng.choice(copies) if rng.random() < 0.7 else f"only {i}") for i in range(200)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, lang string, text string, part string, mask int").repartition(7)
    expected = Counter(masks_by_force(rows))
    for own in (1 << 25, 20):
        got = audit.filter_masks(docs, local_bytes=own, range_bytes=1000, hot=hot)
        assert Counter(map(tuple, got.collect())) == expected
    labels = [(5, 1, 0), (5, 0, 1), (6, None, None), (7, 1, None), (None, 1, 1), (500, 1, 1), *((d, d % 2, int(d % 5 == 0)) for d in range(20, 60))]
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    table = spark.createDataFrame([(*x, "z") for x in labels], "doc_id bigint, quality int, toxic int, lang string")
    assert Counter(map(tuple, audit.audit_filters(docs, table).collect())) == audited_by_force(list(expected.elements()), good, toxic)
    assert audit.audit_filters(docs.limit(0), table).count() == 0


def test_filter_masks_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, *[None] * 11) for r in ROWS], CLASHING).repartition(3)
    assert Counter(map(tuple, audit.filter_masks(docs).collect())) == Counter(masks_by_force([(d, part, t) for d, t, part, _ in ROWS]))


def test_words_and_lines_made_to_collide_stay_apart(spark):
    words = ["ieqh524yng5by1a2", "2mljbd5i/$c`/h~x"]
    docs = spark.createDataFrame([(i, f"{w} x y") for i, w in enumerate(words, 1)], "doc_id bigint, text string")
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()) == Counter({(1, 1, True): 1, (2, 2, True): 1})
    points = [[19969, 19970, 19971, 19973, 19974], [28297, 31062, 29614, 863969, 789708]]
    rows = [(i, "".join(map(chr, p))) for i, p in enumerate(points)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["text"], r["n_dropped"]) for r in got} == {(i, t, 0) for i, t in rows}
    data, starts = np.array(sum(points, []), np.uint32), np.array([0, 5])
    alike, _ = lines.character_shingles(data, starts, starts + 5, 5)
    apart, _ = lines.character_shingles(data, starts, starts + 5, 5, (3, 4))
    assert alike[0] == alike[1] and apart[0] != apart[1]


def test_word_hashes(monkeypatch):
    monkeypatch.setattr(WordHashes, "KEPT", 50)
    rng, hashes = random.Random(5), WordHashes(b"", b"key")
    for _ in range(40):
        words = [bytes(rng.choice(b"abc") for _ in range(rng.choice([1, 2, 3, 60]))) for _ in range(30)]
        got = hashes.of(words)
        for k, key in enumerate((b"", b"key")):
            assert got[k].tolist() == [int.from_bytes(hashlib.blake2b(w, digest_size=8, key=key).digest(), "little") for w in words]
    assert WordHashes(b"").of([]).shape == (1, 0)


def test_buckets_are_whole_whatever_a_task_remembers():
    rng = np.random.default_rng(6)
    for places in (1, 4, 1 << 10):
        known, ties, far = similar.KnownHeads(places), [], []
        for _ in range(30):
            n = rng.integers(0, 6)
            nodes, keys = rng.integers(1, 1000, n), rng.integers(0, 12, (n, 3)) * 7 - 20
            bands, near_keys, near_heads = (c.to_pylist() for c in similar.band_columns(n, np.arange(n), nodes, keys, known))
            for i in range(n):
                assert sorted(bands[i] + near_keys[i]) == sorted(keys[i].tolist())
                far += [(k, int(nodes[i])) for k in bands[i]]
                ties += [(k, int(nodes[i]), h) for k, h in zip(near_keys[i], near_heads[i], strict=True)]
        assert all((k, h) in set(far) for k, _, h in ties)


def test_long_conversations_take_time_in_proportion(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, number int, message string, end string, fresh boolean, turns int"
    said = lambda i: f"turn {i} <|im_end|> \\ é"
    seconds = {}
    for n in (2000, 20000):
        rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'assistant') AS role", "concat('turn ', id, ' <|im_end|> \\\\ é') AS text", "1 AS number", "'m' AS message", "'e' AS end", "true AS fresh", "2 AS turns")
        assert rows.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
        began = time.time()
        (got,) = chat.digests(chat.format_conversations(rows)).collect()
        seconds[n] = time.time() - began
        loss = "".join(said(i) for i in range(n) if i % 3)
        turns = "".join(f"{'assistant' if i % 3 else 'user'}\n{said(i)}\n" for i in range(n))
        assert (got["n_turns"], got["loss_chars"]) == (n, len(loss))
        assert (got["loss_sha256"], got["turns_sha256"]) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (loss, turns))
    assert seconds[20000] < 10
