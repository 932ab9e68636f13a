import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ridgeline.llm import archive, chat, components, encoding, exact, lines, media, mixing, neardup, packing, quality, registry, similar, tokens
from ridgeline.llm.common import table, text_mark

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
FOX = "The quick brown fox jumps over the lazy dog and runs far away from here today"
#: Nulls in every column, empty, blank and long texts, ties, a repeated row, an id given twice, a null id given twice.
ROWS = [
    (1, FOX, "en", "a"), (2, None, "en", None), (3, "", None, "a"), (4, " \n\t \r\n", "de", "b"), (5, FOX, "en", "a"), (5, FOX, "en", "a"), (6, FOX + "  ", None, "b"),
    (7, FOX.replace("lazy", "LAZY") + " and more words to read\n" + FOX, "en", None), (8, "word " * 30000 + "end", "en", "a"), (9, "x", "en", "b"), (10, "X", "en", "b"), (11, "two words", "en", "c"),
    (None, "no id for this text of some words", "fr", "b"), (None, None, None, None), (12, FOX + "\n" + FOX.upper() + "\n\nshort\nshort", "en", "a"), (12, "another text under the same id, long enough to be a line", "en", "a"),
    (13, "é́ü日本語 mixed 😀 text here\n" * 3, "ja", "b"),
]
CLASHING = "doc_id bigint, text string, lang string, source string, n bigint, node bigint, id string, key string, root string, bands string, size string, mark string, body string, n_lines string, line string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *[None] * 11) for r in ROWS], CLASHING).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


def as_tuples(df):
    return Counter(tuple(r) for r in df.collect())


def test_exact(odd, empty):
    groups = defaultdict(list)
    strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
    for d, t, *_ in ROWS:
        groups[(t or "").translate(strip)].append((d, len(t or "")))
    want = Counter()
    for body, members in groups.items():
        longest = max(n for _, n in members)
        keep = min((d for d, n in members if n == longest and d is not None), default=None)
        for d, _ in members:
            want[d, keep, len(members), d == keep, hashlib.sha256(body.encode()).hexdigest()] += 1
    assert as_tuples(exact.exact_groups(odd)) == want
    assert exact.exact_groups(empty).count() == 0


def test_chat(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "<", "|", "<\\|", "\n", "assistant", "a", "é", "<\\n>", "\\\\", "<|im_cont|>"]
    text = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", None, "a\nb", "<|x"]), text()) for c in [*range(40), None] for t in range(rng.randint(1, 5))]
    rows += [(900, 1, "user", "tie"), (900, 1, "user", "tie"), (900, 1, "assistant", "tie"), (900, None, "user", "first")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))  .collect()}
    convs = defaultdict(list)
    for c, t, role, x in rows:
        convs[c].append((t is not None, t or 0, role or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = [(r, x) for *_, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for r, x in turns)
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    merged = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id int, turn int, role string, text string")).first()
    assert merged["formatted"] == "<|im_start|>user\na<|im_cont|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n" and len(merged["loss_spans"]) == 1
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


PAGES = [(1, "http://a/", "same"), (5, "http://b/\r\nX: y z", "same"), (3, None, "same"), (3, None, "same"), (None, "u", "same"), (7, "u", None), (8, "u", ""), (9, "u", "only é"), (None, None, "lone"), (10, "u", "y" * 300000)]


def test_archive(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id bigint, url string, html string, sha256 string")
    payloads, headers = archive.write_archive(pages)
    assert payloads.count() == 5 and headers.count() == len(PAGES)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in archive.index_records(archive.read_records(payloads, headers)).collect())
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max([x for x in (best.get(h or ""), i) if x is not None], default=None)
    want = Counter()
    for i, _, h in PAGES:
        again = best[h or ""] is not None and i != best[h or ""]
        want[i, len((h or "").encode()), "revisit" if again else "response", best[h or ""] if again else None] += 1
    assert got == want
    for r in archive.record_bytes(archive.read_records(payloads, headers)).collect():
        head, rest = bytes(r["record"]).split(b"\r\n\r\n", 1)
        fields = archive.parse_header(head + b"\r\n\r\n")
        assert rest.endswith(b"\r\n\r\n") and len(rest) - 4 == int(fields["content-length"]) and "x" not in fields
    assert Counter(r["record_type"] for r in archive.archive_pages(pages, least=5).collect())["revisit"] == 0
    assert archive.archive_pages(pages.limit(0)).count() == 0


def shingles_of(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def linked(sets, share):
    """Component number of each set by comparing all with all that share an item."""
    parent, posts = list(range(len(sets))), defaultdict(list)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = Counter()
        for g in s:
            common.update(posts[g])
            posts[g].append(i)
        for j, n in common.items():
            if 100 * n >= share * (len(s) + len(sets[j]) - n):
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(sets))]


def near_by_force(rows, k, share):
    sets = [shingles_of(t, k) for _, t, *_ in rows]
    comps = linked(sets, share)
    least = {}
    for c, (d, *_) in zip(comps, rows, strict=True):
        least[c] = min([x for x in (least.get(c), d) if x is not None], default=None)
    return Counter((d, len(s), least[c] if s else d, d == (least[c] if s else d)) for c, s, (d, *_) in zip(comps, sets, rows, strict=True))


@pytest.mark.parametrize("k, share", [(3, 85), (5, 80)])
def test_near_duplicates(odd, empty, spark, sf_dir, k, share, monkeypatch):
    got = lambda d: as_tuples(neardup.near_duplicates(d, k, share).drop("mark"))
    assert got(odd) == near_by_force(ROWS, k, share)
    assert got(empty) == Counter()
    docs = table(spark, sf_dir, "documents")
    want = near_by_force([(r["doc_id"], r["text"]) for r in docs.collect()], k, share)
    assert got(docs) == want
    monkeypatch.setattr(similar, "BLOCK_SETS", 2)  # residues of several blocks, and stars in several tasks
    monkeypatch.setattr(similar, "STAR", 3)
    assert got(docs) == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 2000 + i) for i in range(50)] + [(9, 9)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[top(a)] = top(b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    assert len({(got[x], top(x)) for x in nodes}) == len({top(x) for x in nodes}) == len({got[x] for x in nodes})
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def lines_by_force(rows):
    where = defaultdict(list)
    for d, mark, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            x = x.translate(LOWER).strip(" \t\n\x0b\x0c\r")
            if len(x) >= lines.LEAST:
                where[x].append((d is not None, d or 0, mark, i))
    texts = list(where)
    comps = linked([frozenset(x[i : i + lines.SHINGLE] for i in range(max(1, len(x) - lines.SHINGLE + 1))) for x in texts], lines.SHARE)
    kept = {}
    for c, x in zip(comps, texts, strict=True):
        kept[c] = min([*where[x], *([kept[c]] if c in kept else [])])
    gone = {p for c, x in zip(comps, texts, strict=True) for p in where[x]} - set(kept.values())
    out = Counter()
    for d, mark, t in rows:
        drop = {i for i in range(len((t or "").split("\n"))) if (d is not None, d or 0, mark, i) in gone}
        out[d, t if not drop else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop), len(drop)] += 1
    return out


@pytest.mark.parametrize("blocks", [similar.BLOCK_SETS, 2])
def test_lines(odd, empty, spark, sf_dir, blocks, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_SETS", blocks)
    for docs in (odd, table(spark, sf_dir, "documents")):
        rows = [tuple(r) for r in docs.select("doc_id", F.hex(text_mark()), "text").collect()]
        assert as_tuples(lines.dedup_lines(docs).select("doc_id", "text", "n_dropped")) == lines_by_force(rows)
    assert lines.dedup_lines(empty).count() == 0


def test_encoder():
    rng = random.Random(1)
    pool = "aAbBzZéÉßñÑüÜ'stTrevmlld''  \n\n\t\r\x0b\x0c.,!?-_#$%&*|<>0129²¹½ªº\x00\x1f\x85\xa0 “”’ΣςİıŉﬁÅ日本語кКд😀́̈"
    texts = ["".join(rng.choice(pool[: rng.choice([30, len(pool)])]) for _ in range(rng.randint(0, 40))) for _ in range(5000)] + ["<|endoftext|> a", "", "x <|startoftext|>y"]
    for path, spaces in ((BYTES, True), (WORDS, False)):
        e = encoding.Encoder(path, spaces)
        ids, bounds = e.encode(texts)
        want, ends = e.whole(texts)
        assert (ids == want).all() and (bounds == [0, *ends]).all()


def ids_of(path, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_tokens(odd, empty, spark):
    got = tokens.token_table(odd, BYTES).collect()
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = Counter(), 0
    for d, t, *_ in rows:
        ids = ids_of(BYTES, t, 0)
        want[d, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in got) == want
    assert tokens.token_table(empty, BYTES).count() == 0


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(odd, empty):
    rows = packing.pack_documents(odd, WORDS).collect()
    want = Counter()
    for d, t, *_ in ROWS:
        ids = ids_of(WORDS, t, 1)
        for k in range(0, len(ids), 4096):
            want[d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    check_packing(rows, 4096)
    assert packing.pack_documents(empty, WORDS).count() == 0


def test_plan():
    rng = np.random.default_rng(0)
    for capacity, n in ((8, 50), (64, 3000), (4096, 20000), (4096, 0), (100, 1)):
        lengths = np.clip(rng.exponential(capacity / 4, n).astype(int), 1, capacity)
        counts = np.bincount(lengths, minlength=capacity + 1)
        plan, sequences = packing.plan_packing(counts, capacity)
        used = defaultdict(list)
        for k in range(1, capacity + 1):
            mine = plan[plan[:, 0] == k]
            for r in range(counts[k]):
                row = mine[np.searchsorted(mine[:, 1], r, "right") - 1]
                nth = r - row[1]
                used[row[2] + nth // row[3]].append((row[4] + nth % row[3] * k, k))
        assert len(used) == sequences
        for places in used.values():
            ends = np.cumsum([k for _, k in sorted(places)])
            assert ends[-1] <= capacity and [o for o, _ in sorted(places)] == [0, *ends[:-1]]
        assert sequences <= 1.02 * -(-int(lengths.sum()) // capacity) + 2
    a = np.array([[1.0, 1, 0], [0, 1, 2]])
    assert np.allclose(packing.nnls(a, np.array([3.0, 4])) @ a.T, [3, 4]) and (packing.nnls(a, np.array([-1.0, 2])) >= 0).all()


def test_media(odd, empty):
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.media_features(odd).collect()}
    for d, t, *_ in ROWS:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[d, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["feature"].startswith(f"codec=raw ;duration={len(padded) // 64}/25;")
    file = media.mux(media.pad(b"x" * 5000))
    track = media.read_tracks(file)[0]
    assert track["keys"].tolist() == [0, 16, 32, 48, 64] and file[track["offsets"][16] :][:64] == b"x" * 64
    assert b"".join(file[o : o + n] for o, n in zip(track["offsets"], track["sizes"], strict=True)) == media.pad(b"x" * 5000)
    wide = file.replace(b"stco", b"free", 1)
    assert "KeyError" in media._index_one(wide)["error"] and "overruns" in media._index_one(file[:-10])["error"]
    assert media._index_one(b"")["error"] == "no track"
    assert media.media_features(empty).count() == 0


def test_mixing(odd, empty, spark, sf_dir):
    for docs in (odd, table(spark, sf_dir, "documents")):
        rows = mixing.mix_sources(docs).collect()
        assert sorted(rows, key=str) == sorted(mixing.mix_sources(docs.repartition(5)).collect(), key=str)
        sizes = Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in docs.collect())
        assert Counter((r["doc_id"], r["size"]) for r in rows) == sizes
        total = sum(r["size"] for r in rows)
        per = {r["source"]: (r["target"], r["source_size"]) for r in rows}
        names = sorted(per, key=lambda s: (s is None, s or ""))
        want = mixing.water_fill([per[n][1] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * total, 2)
        for n, w in zip(names, want, strict=True):
            taken = sum(r["taken"] for r in rows if r["source"] == n)
            assert abs(per[n][0] - w) < 1e-6 * max(1, w) and abs(taken - w) <= mixing.BLOCK_WORDS
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix_sources(empty).count() == 0


def test_apportionment():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        weights, most = rng.random(n) * 100, rng.integers(0, 30, n)
        seats = int(rng.integers(0, most.sum() + 5))
        want, queue = np.zeros(n, int), [(-w, i) for i, w in enumerate(weights) if most[i]]
        heapq.heapify(queue)
        for _ in range(min(seats, most.sum())):
            _, i = heapq.heappop(queue)
            want[i] += 1
            if want[i] < most[i]:
                heapq.heappush(queue, (-weights[i] / (2 * want[i] + 1), i))
        assert (mixing.sainte_lague(weights, seats, most) == want).all()
    assert np.allclose(mixing.water_fill([10, 10, 100], [5, 2, 1], 180, 2), [20, 20, 140])
    sizes = np.array([5, 0, 40, 7])
    for words in (0, 1, 51, 52, 60, 104):
        taken = mixing.take_blocks(sizes, words, 8, np.random.default_rng(0))
        assert taken.sum() == words and (taken <= 2 * sizes).all()


def test_quality(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1, None), (3, 0, 1), (6, None, 0), (None, 1, 0), (9, 7, 0), (1, 1, None)], "doc_id bigint, quality int, toxic int")
    rows = quality.classify(odd, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    none = quality.classify(odd, labels.limit(0)).collect()
    assert {round(r["score"], 6) for r in none} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in quality.classify(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = registry.queries()[name](spark, sf_dir)
    assert as_tuples(got) == Counter(c.execute(f"select {', '.join(got.columns)} from ({registry.oracle_sql()[name]})").fetchall())


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        after = after.persist()
        rows = after.collect()
        if name == "quality":
            scores = {r["doc_id"]: r["predicted"] for r in quality.classify(before, table(spark, sf_dir, "labels")).collect()}
            assert {r["doc_id"] for r in rows} == {d for d, p in scores.items() if p}
        if name == "lines":
            force = lines_by_force([tuple(r) for r in before.select("doc_id", F.hex(text_mark()), "text").collect()])
            assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter({(d, t): n for (d, t, _), n in force.items()})
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "near duplicates":
            force = near_by_force([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert {r["doc_id"] for r in rows} == {d for d, _, _, kept in force if kept}
        if name == "mix":
            plan = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) if r["size"] else 0 for r in mixing.mix_sources(before, block_words=corpus_pipeline.MIX_BLOCK_WORDS).collect()}
            assert Counter(r["doc_id"] for r in rows) == Counter({d: n for d, n in plan.items() if n})
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect()
    assert sum(r["piece"] == 0 for r in packed) == before.count()
    check_packing(packed, 4096)
    assert as_tuples(corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32")) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)
