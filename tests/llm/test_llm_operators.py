"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import ann, lines, mixing, neardup, packing, pii, quality, queries, records, secrets, sharding, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, shard string, spans string, taken string, distance string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = [None, "", " \n\t ", "one", "one two three", "x" * 5000, "Zoé ñandú ß 中文   \x1c end", "a b c d e f g h " * 3000, "A B C d e", "a b c D E"]
    for _ in range(n):
        texts.append("\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(0, 14))) for _ in range(rng.randint(1, 30))))
    texts += texts[10:40] + [texts[11]] * 30
    for t in texts[60:80]:
        w = t.split(" ")
        if len(w) > 4:
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    rows = [(i, t, rng.choice(["en", "de", None]), "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "ü", None, "z"]), len(t or "")) + ("?",) * 6 for i, t in enumerate(texts)]
    rows += [rows[15], rows[15], (None, "no id here at all", "en", "a", 17) + (None,) * 6]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, nothing):
    path = tokens.default_path("word_bpe_49k.json")
    assert lines.drop_boilerplate_lines(nothing).count() == 0
    assert sharding.shard_by_bytes(nothing, 4).count() == 0
    assert pii.find_personal_data(nothing).count() == 0
    assert records.read_files(spark, records.write_records(nothing, path)).count() == 0
    assert mixing.mix_sources(nothing.withColumn("size", F.lit(1).cast("long"))).count() == 0
    assert packing.pack_documents(nothing, path).count() == 0
    assert secrets.scan_documents(nothing).count() == 0
    assert neardup.near_duplicates(nothing).count() == 0
    assert quality.judge_documents(nothing).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>, score string")).count() == 0


# 1


def test_boilerplate_lines(docs, rows):
    pages, held = Counter(), Counter()
    key = lambda x: x.strip(" \t\r\x0b\x0c")
    for r in rows:
        pages[r[3]] += 1
        held.update({(r[3], key(x)) for x in (r[1] or "").split("\n") if key(x)})
    bad = {k for k, n in held.items() if n >= 3 and n > 0.05 * pages[k[0]]}
    want = []
    for r in rows:
        kept = None if r[1] is None else [x for x in r[1].split("\n") if (r[3], key(x)) not in bad]
        want.append((r[0], None if kept is None else "\n".join(kept), 0 if kept is None else r[1].count("\n") + 1 - len(kept), r[5]))
    got = lines.drop_boilerplate_lines(docs, ratio=0.05, least_pages=3).select("doc_id", "text", "lines_dropped", "size")
    assert bad and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_default_limits_find_rarer_lines_and_small_hosts(spark):
    """A line on 3 % of a site goes and one on 1 % stays; a line on all of three or four pages goes, one on two pages stays."""
    rows = [(i, f"page {i}" + ("\nmenu" if i % 33 == 0 else "") + ("\nchance" if i % 100 == 1 else ""), "large") for i in range(400)]
    rows += [(1000 * n + i, f"own {n} {i}\nfooter", f"host{n}") for n in (2, 3, 4) for i in range(n)]
    out = lines.drop_boilerplate_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    text = {r.doc_id: r.text for r in out}
    want = {i: t.replace("\nmenu", "") if s == "large" else t if s == "host2" else t.replace("\nfooter", "") for i, t, s in rows}
    assert text == want


def test_salted_join_gives_the_same(docs, monkeypatch):
    one = sorted(map(repr, lines.drop_boilerplate_lines(docs, ratio=0.05, least_pages=3).collect()))
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert one == sorted(map(repr, lines.drop_boilerplate_lines(docs, ratio=0.05, least_pages=3).collect()))


# 2


def test_shards(docs, rows):
    got = sharding.shard_by_bytes(docs, 4).select("doc_id", "text", "size", "shard", "slot", "kept").collect()
    by, sizes = defaultdict(list), Counter()
    for r in got:
        assert r.size == len((r.text or "").encode()) + 1
        by[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(abs(s - sum(sizes.values()) / 4) for s in sizes.values()) <= max(len((r[1] or "").encode()) + 1 for r in rows) * 2


def test_shards_of_one_text_are_cut_by_id(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text in a third of all rows").alias("text"))
    sizes = [r[1] for r in sharding.shard_by_bytes(d, 8).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.01 * sum(sizes)


def test_large_shards_are_sorted_in_more_parts(docs, monkeypatch):
    want = sorted(map(repr, sharding.shard_by_bytes(docs, 4).select("doc_id", "size", "shard").collect()))
    monkeypatch.setattr(sharding, "CELL_BYTES", 1000)
    got = sharding.shard_by_bytes(docs, 4).select("doc_id", "size", "shard", "slot").collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(want) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_rank_among_probes():
    rng = np.random.default_rng(0)
    p = sorted({(int(a), int(b)) for a, b in rng.integers(0, 6, (20, 2))})
    k = rng.integers(0, 7, (500, 2))
    want = [sum(q <= (a, b) for q in p) for a, b in k.tolist()]
    for few in (40, 500):
        got = sharding.below(np.array([q[0] for q in p]), np.array([q[1] for q in p]), k[:few, 0], k[:few, 1])
        assert got.tolist() == want[:few]


# 3


def _base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_base_spans_by_fuzzing():
    rng = random.Random(1)
    bits = ["@", ".", "1", "25", "256", "4111 1111 1111 1111", "4012-8888-8888-1881", "+1", "-", " ", "(", ")", "a", "é", "%", "0", "9.9", "a@b.c", "4", "٣", "\n"]
    for _ in range(20000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 24)))
        assert [(pii.KINDS[k], a, b) for k, a, b, ok in pii.base_spans(t) if ok] == _base(t), t


def test_personal_data(spark):
    rng = random.Random(2)
    texts = ["call me +1 (743) 555-3824 or phone 212-555-0188 now", "mail bob [at] site [dot] org please", "version 1.2.3.4 and host 70.23.22.57", "card 4111111111111111 order 4111111111111112", "ssn 123-45-6789", "", None, "clean words only", "9" * 60000, "a@" * 3000]
    texts += [f"phone {rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)} tel" for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, "x@y.zz")], "doc_id long, text string").withColumn("n_ip", F.lit("clash"))
    out = pii.find_personal_data(d).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        t = texts[r.doc_id] or "" if r.doc_id is not None else "x@y.zz"
        base = _base(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in pii.KINDS[:4]]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    by = {r.doc_id: r.spans for r in out}
    assert by[7] == by[5] == by[6] == "" and sum("local_phone" in by[i] for i in range(10, 50)) >= 30


def test_label_model_recovers_reliabilities():
    rng = np.random.default_rng(3)
    hit, counts = (0.95, 0.85, 0.7, 0.6), Counter()
    truth = rng.random(20000) < 0.3
    for y in truth:
        v = tuple(int((1 if rng.random() < h else -1) * (1 if y else -1)) for h in hit)
        counts[3, pii.VOTES.index(v)] += 1
    prior, table, post = pii.label_model(counts)
    assert abs(prior[3] - 0.3) < 0.03 and all(abs(table[i, 1, 2] - h) < 0.04 for i, h in enumerate(hit))


def test_classifier_on_held_out_spans():
    rng = np.random.default_rng(4)
    f = rng.integers(0, pii.BUCKETS, (4000, 8))
    y = (f[:, 0] < pii.BUCKETS // 2).astype(float)
    f[:, 0] = f[:, 0] // 64
    w = pii.fit_classifier(f[:3000], y[:3000])
    assert (((w[f[3000:]].sum(1) + w[-1]) > 0) == y[3000:]).mean() > 0.95


# 4


def test_records_round_trip(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    path = tokens.default_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    files = records.write_records(docs, path, f"file://{tmp_path}/r", 3)
    got = [tuple(r) for r in records.read_files(spark, files).collect()]
    want, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    fs, at = pafs.FileSystem.from_uri(files[0][0])
    doc, ids = records.unpack(records.record_at(fs, at, 1))
    assert (doc, len(ids)) == (want[1][0], want[1][2])


def test_damage_is_noticed():
    good = records.frame(b"abcdef")
    assert list(records.read_records(io.BytesIO(good + good))) == [b"abcdef"] * 2
    for at in (0, 9, 14, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(records.read_records(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(records.read_records(io.BytesIO(good[:-2])))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_exact(name, monkeypatch):
    from tokenizers import Tokenizer

    e, plain = tokens.Encoder(tokens.default_path(name), limit=50), Tokenizer.from_file(tokens.default_path(name))
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "a", "The", "don't", "'s", "É", "ß", "中", " ", "́", "12", ",", "!!", "\x01", "\x00", "\x1c", "<|endoftext|>", "İ", "Σ", "word", "x" * 70]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += [" ".join(rng.choice(["the", "Dog,", "cat.", "naïve", "Über", "run"]) for _ in range(20)) for _ in range(50)]
    texts += ["<|endoftext|>", "<|endoftext|> a", "a <|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b", "<|ENDOFTEXT|>", "<|startoftext|> x", "<|endo", "a <| b", "x\n<|endoftext|>\n<|endoftext|>"]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, e.dtype).tobytes() for t in texts]
    assert e.encode(texts) == want
    monkeypatch.setattr(tokens.pieces, "__defaults__", (5,))
    assert e.encode(texts) == want


# 5


def _mix(sizes):
    """sizes: {source: words}. Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)


def test_mix(docs, rows):
    sized = docs.withColumn("size", mixing.word_count("text"))
    got = mixing.mix_sources(sized).select("doc_id", "text", "source", "size", "source_size", "target", "taken").collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    want, taken = _mix(sizes), Counter()
    for r in got:
        assert r.size == len(WORDS.findall(r.text or "")) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(taken[s] == int(want[s] + 1e-6) for s in sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(sized.repartition(5)).select("doc_id", "text", "source", "size", "source_size", "target", "taken").collect()))


# 6


def test_plan_is_best_fit_decreasing():
    rng = random.Random(6)
    for capacity in (7, 64, 2048):
        for n in (0, 1, 30, 700):
            lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 5)), capacity]) for _ in range(n)]
            fill, seen = Counter(), set()
            for size, recs in packing.plan(Counter(lengths), capacity).items():
                assert sum(m * q for _, m, q, _, _ in recs.tolist()) == lengths.count(size)
                for rank, m, q, first, off in recs.tolist():
                    for b in range(first, first + m):
                        for k in range(q):
                            assert (b, off + k * size) not in seen
                            seen.add((b, off + k * size))
                        assert fill[b] == off
                        fill[b] += q * size
            assert sorted(capacity - f for f in fill.values()) == sorted(packing.sequential_best_fit(lengths, capacity))


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = tokens.default_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter()
    for r in rows:
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        want.update((r[0], k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    got = packing.pack_documents(docs, path).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= 2048
    assert len(by) == len(packing.sequential_best_fit([r.length for r in got]))


# 7


def _secrets(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign", m[2]))
    out += [(m.start(), 1, m.end(), "access", m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex", m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(7)
    bits = ["token", "Secret", "api_key", "passwd", "=", ":", " ", '"', "'", "abcdef", "abc", "AKIA", "A" * 17, "0123456789abcdef" * 2, "é", "\n", "😀", "deadbeef", "x.y"]
    live = "ghp_" + "Ab1" * 12
    copied = "ghp_" + "Zz9" * 12
    texts = [None, "", f"my {live} key", *[f"sample {copied} {i}" for i in range(4)], "AKIA" * 3 + "A" * 30, "token: secret=abcdefgh", "password: token: abcdefghi"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(300)] + ["token=abcdef " * 2000]
    d = spark.createDataFrame([(i, t, f"s{i % 5}") for i, t in enumerate(texts)] + [(3, texts[3], None)], "doc_id long, text string, source string").withColumn("spans", F.lit(1))
    got = secrets.scan_documents(d).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        base = _secrets(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[3] == k for x in base) for k in ("assign", "access", "hex")]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    by = {r.doc_id: r for r in got}
    assert by[2].spans == "vendor:3:43" and by[2].n_live == 1
    assert by[4].spans == "" and by[4].n_copied == 1


def test_repositories_decide_too(spark, monkeypatch):
    """A value in many repositories of one owner is copied, in one fewer it looks live; the salted join says the same."""
    n = secrets.COPIED_REPOSITORIES
    many, few = "ghp_" + "Mm1" * 12, "ghp_" + "Ff2" * 12
    d = spark.createDataFrame([(i, many if i < n else few, "one") for i in range(2 * n - 1)] + [(2 * n - 2, few, "one")], "doc_id long, text string, source string")
    want = {i: int(i >= n) for i in range(2 * n - 1)}
    for bound in (secrets.BROADCAST_VALUES, 0):
        monkeypatch.setattr(secrets, "BROADCAST_VALUES", bound)
        assert {r.doc_id: r.n_live for r in secrets.scan_documents(d).collect()} == want
        each = {r.value_hash: (r.owners, r.repositories, r.copied) for r in secrets.find_secrets(d).collect()}
        assert sorted(each.values()) == [(1, n - 1, False), (1, n, True)]


# 8


def _shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _components(rows):
    sets = [_shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        c = min((x for x in least[find(i)] if x is not None), default=None)
        out.append((r[0], len(sets[i]), c, r[0] == c))
    return sorted(map(repr, out))


def near(spark, rows, **config):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(repr, map(tuple, neardup.near_duplicates(d.repartition(3)).select("doc_id", "n_shingles", "component_id", "kept").collect())))


def test_near_duplicates(spark, docs, rows):
    got = neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(repr, map(tuple, got))) == _components(rows)


def test_chains_and_groups_of_near_copies(spark, monkeypatch):
    """A chain whose ends are far apart, and copies of one text that mostly do not reach each other; also with tiny parts, so that
    all ways through a large bucket are taken."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, text = [], [word() for _ in range(200)]
    for i in range(25):
        rows.append((i, " ".join(text)))
        text = text[:]
        text[(i * 7) % 195] = word()
        text[(i * 7) % 195 + 1] = word()
    base = [word() for _ in range(300)]
    for i in range(60):
        t = base[:]
        for k in rng.sample(range(0, 300, 6), 5):
            t[k] = word()
        rows.append((100 + i, " ".join(t)))
    want = _components(rows)
    assert near(spark, rows) == want
    monkeypatch.setattr(neardup, "CHUNK", 8)
    monkeypatch.setattr(neardup, "PIVOT_ROWS", 4)
    assert near(spark, rows) == want
    monkeypatch.setattr(neardup, "VOLUME", 1500)
    monkeypatch.setattr(neardup, "DENSE", 1)
    assert near(spark, rows) == want


def test_common_counts():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(30)]
    left, right = np.arange(0, 20), np.arange(12, 30)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    for a, b in ((left, right), (np.arange(30), np.arange(30))):
        want = [[len(np.intersect1d(sets[i], sets[j])) if i != j else None for j in b] for i in a]
        got = neardup.common_counts(sets, a, b)
        assert all(w is None or got[x, y] == w for x, row in enumerate(want) for y, w in enumerate(row))


def test_a_large_group_of_near_copies(spark):
    """2 000 copies of one text, changed in up to a sixth of its words: most pairs are near the threshold and not linked."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(150)], []
    for i in range(2000):
        t = base[:]
        for k in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            t[k] = word()
        rows.append((i, " ".join(t)))
    assert near(spark, rows) == _components(rows)


def test_near_duplicates_at_another_threshold(spark):
    """Pairs at 0.80 to 0.85 are linked at 80, also in the pipeline's stage, and not at 85."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, linked = [], {80: set(), 85: set()}
    for i in range(40):
        text = [word() for _ in range(204)]
        other = text[:]
        for k in range(4 + i % 3):  # every change costs five shingles of 200: overlaps 0.82, 0.78 and 0.74
            other[20 + 30 * k] = word()
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
        a, b = _shingles(rows[-2][1]), _shingles(rows[-1][1])
        for percent, ids in linked.items():
            if 100 * len(a & b) >= percent * len(a | b):
                ids.add(2 * i + 1)
    assert linked[80] and not linked[85]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent, ids in linked.items():
        assert {r.doc_id for r in neardup.near_duplicates(d, percent=percent).filter("not kept").collect()} == ids
    whole = d.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, whole, "").collect()} == {r[0] for r in rows} - linked[80]


@pytest.mark.parametrize("percent", [80, 85])
def test_limits_follow_from_the_threshold(percent):
    """Bands miss a pair at the threshold with a chance below 10^-6; no estimate that counts is ruled out by equal registers."""
    limit, m = neardup.Limit(percent), neardup.M
    assert limit.rows * limit.bands == m
    for r in np.linspace(percent / 100, 1, 40):
        u, v, j = 1 / (1 + r), r / (1 + r), percent / 100
        p = lambda x: -np.log1p(-max(x, 0) * (neardup.B - 1) / neardup.B) / np.log(neardup.B)
        assert (1 - (1 - p(u - v * j) - p(v - u * j)) ** limit.rows) ** limit.bands < 1e-6
    n = np.linspace(percent / 100, 1, 31)
    for same in range(limit.least_same):
        more, size = np.repeat(np.arange(m - same + 1), len(n)), np.tile(n, m - same + 1)
        assert (neardup.estimate(size, np.ones_like(size), more, m - same - more) < limit.least).all()


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    a, b = np.sort(x[:800]), np.sort(x[200:1000])
    assert (neardup.merge(neardup.sketch(a), neardup.sketch(b)) == neardup.sketch(np.unique(np.concatenate([a, b])))).all()
    sa, sb = neardup.sketch(a), neardup.sketch(b)
    got = neardup.estimate(np.array([800.0]), np.array([800.0]), np.array([(sa > sb).sum()]), np.array([(sa < sb).sum()]))[0]
    assert abs(got - 0.6) < 0.15


def test_components_by_star_steps(spark):
    rng = random.Random(10)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# 9


def _stats(t):
    w = WORDS.findall(t or "")
    seen, cover = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    ls = [x for x in (t or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(cover)


def test_base_statistics(docs, rows):
    got = quality.judge_documents(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = []
    for r in rows:
        s = _stats(r[1])
        want.append((r[0], *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert sorted(map(repr, (tuple(r)[:7] for r in got))) == sorted(map(repr, want))
    assert not any(r.kept and r.base_failed for r in got)


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(11)
    rows = []
    for i in range(700):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(60, 300))]
        odd = i % 10 == 0
        rows.append((i, "\n".join(" ".join(w[k : k + 20]) + (" | # *** $$$ %%%" if odd else "") for k in range(0, len(w), 20)), "en", f"s{i % 2}"))
    got = quality.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert [r.doc_id for r in got if r.kept == (r.doc_id % 10 == 0)] == []


def test_estimates_against_numpy(spark):
    """One group: the distances are those of concentration steps written with matrices."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, quality.N)) @ np.diag([1, 2, 0.5, 0.2, 0.3]) + 5
    x[:60] += 30
    d = spark.createDataFrame([("en", "s", False, *map(float, r)) for r in x], "qs_lang string, qs_group string, base_failed boolean, " + ", ".join(f"qs_x{i} double" for i in range(quality.N)))
    got = sorted(r.distance for r in quality.Rules(d).judge(d).collect())
    floor = np.diag(np.array(quality.FLOORS) ** 2)
    best = None
    quarter = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    for m, s in ((quarter[1], np.diag(((quarter[2] - quarter[0]) / 1.349) ** 2) + floor), (x.mean(0), np.cov(x.T, bias=True) + floor)):
        for _ in range(quality.STEPS):
            dist = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
            b = np.floor(64 * np.log2(dist + 1e-9))
            cut = np.sort(b)[int(np.ceil(0.75 * len(b))) - 1]
            near = x[b <= cut]
            m, s = near.mean(0), quality.CONSISTENCY * np.cov(near.T, bias=True) + floor
        det = np.linalg.slogdet(s)[1]
        if best is None or det < best[0]:
            best = (det, m, s)
    want = sorted(np.einsum("ij,jk,ik->i", x - best[1], np.linalg.inv(best[2]), x - best[1]))
    assert np.allclose(got, want, rtol=1e-6) and (np.array(want) > quality.LIMIT).sum() == 60


# 10


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1000:1800] = x[1000] + rng.normal(size=(800, 16)) * 1e-3
    x[500] = x[501] = x[502]
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)] + [(9000, None, "q"), (9100, [0.0] * 16, "q"), (9200, [float("nan")] * 16, "q"), (9300, [1.0, None] * 8, "q"), (9400, [1.0], "q"), (None, x[0].tolist(), "q")]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    y, hits = x.astype(float), 0
    assert sorted(got) == list(range(0, 3000, 100))
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(f[2] - d[f[1]]) < 1e-12 for f in found)
        assert [f[1:] for f in found] == sorted([f[1:] for f in found], key=lambda f: (f[1], f[0]))
        d[q] = np.inf
        hits += len({f[1] for f in found} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert hits >= 0.95 * 10 * len(got)


def test_queries_on_a_centroid_find_enough(spark):
    """Far groups of four copies own their centroids, and an id stands on many rows; each query still finds ten, nearly the nearest."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(20, 8))[rng.integers(0, 20, 4000)] * 5 + rng.normal(size=(4000, 8)) * 0.1
    far = rng.normal(size=(10, 8)) * 1000
    for g in range(10):
        x[400 * g : 400 * g + 4] = far[g]
    ids = np.arange(4000)
    ids[801:804] = 800
    d = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(d).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    assert sorted(got) == list(range(0, 4000, 100))
    hits = 0
    for q, found in got.items():
        assert sorted(f[0] for f in found) == list(range(1, 11))
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, dist)) if ids[i] != q][:10]
        hits += len({f[1] for f in found} & set(ids[order].tolist()))
    assert hits >= 0.95 * 10 * len(got)


def test_lists_are_added_until_they_hold_enough():
    c = np.array([[0.0], [1.0], [1.3], [2.0], [9.0]])
    graph = ann.CentroidGraph(c)
    sizes = np.array([1, 50, 50, 50, 50])
    visits = lambda least: graph.visits(np.array([[0.0]]), 0.4, sizes, least)[1].tolist()
    assert visits(1) == [0] and visits(11) == [0, 1, 2] and visits(1000) == [0, 1, 2, 3, 4]


def _served(x):
    """Lists, largest list of the fitted vectors by their mean, lists a vector, recall at 10 and share of lists read."""
    count = int(np.sqrt(len(x)))
    graph = ann.CentroidGraph(ann.balanced_centroids(x, count))
    ratio, sizes = ann.fitted_ratio(graph, x, 10), np.bincount(ann._nearest(x, graph.c), minlength=len(graph.c))
    row, lists, own = graph.stores(x)
    member = np.zeros((len(x), len(graph.c)), bool)
    member[row, lists] = True
    assert own.sum() == len(x) and member.any(1).all()
    q = np.arange(0, len(x), 20)
    read = np.zeros((len(q), len(graph.c)), bool)
    read[graph.visits(x[q], ratio, sizes, 11)] = True
    d = ann._distances(x[q], x)
    d[np.arange(len(q)), q] = np.inf
    near = np.argpartition(d, 10, axis=1)[:, :10]
    return sizes.max() * count / len(x), member.sum() / len(x), np.mean([(member[n] & r).any(1).mean() for n, r in zip(near, read)]), read.mean()


def test_lists_of_the_supplied_table(duck):
    """Balanced lists, boundary vectors in more than one, and a recall above 0.9; unstructured vectors, so most lists are read."""
    x = np.array([r[0] for r in duck.sql("SELECT embedding FROM embeddings ORDER BY vec_id").fetchall()], float)
    balance, replicas, recall, _ = _served(x)
    assert balance <= ann.BALANCE and replicas > 1.05 and recall >= 0.9


def test_lists_of_clustered_vectors():
    """Clusters of very different sizes: balanced, and few lists are read."""
    rng = np.random.default_rng(19)
    x = rng.normal(size=(50, 32))[rng.choice(50, 5000, p=rng.dirichlet(np.full(50, 0.4)))] + rng.normal(size=(5000, 32)) * 0.3
    balance, replicas, recall, read = _served(x)
    assert balance <= ann.BALANCE and replicas > 1 and recall >= 0.95 and read < 0.25


def test_few_vectors(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.search(d).orderBy("rank").collect()] == [(0, 1, 7), (0, 2, 1)]


# queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_pipeline_stages(spark, docs, rows):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    plain = lambda d: Counter(tuple(r) for r in d.select(*names).collect())
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality rules"](spark, docs, "")
    judged = quality.judge_documents(docs, least_words=corpus_pipeline.LEAST_WORDS)
    assert kept.columns == names and plain(kept) == plain(judged.filter("kept"))
    cleaned = stage["line dedup"](spark, docs, "")
    assert cleaned.columns == names and all(r.n_chars == len(r.text or "") for r in cleaned.collect())
    single = stage["near-duplicate removal"](spark, docs, "")
    want = Counter()
    for r in {tuple(r[:5]) for r in rows}:
        want[r] += 1
    comps = {(r.doc_id, r.text_key): r.kept for r in neardup.near_duplicates(docs).collect()}
    keys = {(r.doc_id, r.text): r.k for r in docs.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    assert plain(single) == Counter({r: n for r, n in want.items() if comps[r[0], keys[r[0], r[1]]]})
    mixed = stage["source mix"](spark, docs, "")
    taken = mixing.mix_sources(docs.withColumn("size", mixing.word_count("text"))).groupBy("source").agg(F.sum("taken")).collect()
    have = mixed.groupBy("source").agg(F.sum(mixing.word_count("text"))).collect()
    assert mixed.columns == names and {tuple(r) for r in have} == {tuple(r) for r in taken if r[1]}


def _plain_pipeline(rows):
    """Rows after quality rules (groups here are too small for estimates), line dedup and near-duplicate removal, in plain Python."""
    kept = []
    for r in rows:
        n, *_, repeated = _stats(r[1])
        if n >= 1 and 100 * repeated <= 50 * n:
            kept.append(r)
    key = lambda x: x.strip(" \t\r\x0b\x0c")
    pages, held = Counter(r[3] for r in kept), Counter()
    for r in kept:
        held.update({(r[3], key(x)) for x in r[1].split("\n") if key(x)})
    bad = {k for k, n in held.items() if n >= lines.LEAST_PAGES and n > lines.RATIO * pages[k[0]]}
    clean = []
    for r in kept:
        own = [x for x in r[1].split("\n") if (r[3], key(x)) not in bad]
        t = "\n".join(own)
        clean.append((r[0], t, r[2], r[3], len(t) if t != r[1] else r[4]))
    sets = [_shingles(r[1]) for r in clean]
    root = list(range(len(clean)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(clean)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(clean):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    single = [r for i, r in enumerate(clean) if r[0] == least[find(i)]]
    return kept, clean, single


def test_pipeline_against_plain_python(spark):
    from tokenizers import Tokenizer

    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(84):
        text = [" ".join(word() for _ in range(rng.randint(1, 15))) for _ in range(rng.randint(1, 12))]
        if i % 3 == 0:
            text.insert(rng.randrange(len(text) + 1), "Home | About | Contact")
        if i % 9 == 8:
            text = rows[-1][1].split("\n")[:]
            text[-1] += " more" * (i % 2)
        rows.append((i, "\n".join(text), f"l{i % 6}", ["a", "b", None][i % 3 if i % 7 else 0], 0))
    rows += [(90, None, "l0", "a", 0), (91, "", "l1", "a", 0), (92, " \n\t", "l2", "b", 0), (93, "x y z " * 50, "l3", "b", 0), (94, "<|endoftext|> odd text", "l4", None, 0)]
    rows = [(*r[:4], len(r[1] or "")) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want, got = _plain_pipeline(rows), []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        got.append(sorted(map(tuple, docs.collect()), key=repr))
    for have, plain in zip(got, want):
        assert have == sorted(plain, key=repr)
    assert len(want[0]) > len(want[2]) > 60 and any("Home | About" in r[1] for r in want[0]) and not any("Home | About" in r[1] and r[3] == "a" for r in want[1])
    size = {r[0]: len(WORDS.findall(r[1])) for r in want[2]}
    sizes = Counter()
    for r in want[2]:
        sizes[r[3]] += size[r[0]]
    mixed = [tuple(r) for r in corpus_pipeline.mix(spark, docs, "").collect()]
    taken, each, source = Counter(), Counter(), {r[0]: r for r in want[2]}
    for r in mixed:
        n = len(WORDS.findall(r[1]))
        taken[r[3]] += n
        each[r[0]] += n
        assert r[2:4] == source[r[0]][2:4] and WORDS.findall(r[1]) == WORDS.findall(source[r[0]][1])[:n]
    assert {k: int(v + 1e-6) for k, v in _mix(sizes).items()} == dict(taken) and all(n <= 2 * size[k] for k, n in each.items())
    t = Tokenizer.from_file(tokens.default_path("word_bpe_49k.json"))
    pieces = Counter()
    for r in mixed:
        ids = np.array(t.encode(r[1], add_special_tokens=False).ids + [0], "<u4")
        pieces.update((r[0], k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    packed = corpus_pipeline.pack(spark, spark.createDataFrame(mixed, docs.schema), "").collect()
    assert Counter(tuple(r)[:5] for r in packed) == pieces
    assert len({r.sequence_id for r in packed}) == len(packing.sequential_best_fit([r.length for r in packed]))


def test_pieces_with_clashing_names(spark):
    d = spark.createDataFrame([(1, 700, "x", 5), (2, 1400, "y", 6)], "id int, length long, sequence_id string, offset int")
    out = packing.best_fit(d)
    assert out.columns == ["id", "length", "sequence_id", "offset"] and out.dtypes[2:] == [("sequence_id", "bigint"), ("offset", "bigint")]
    assert {r.id: (r.sequence_id, r.offset) for r in out.collect()} == {2: (0, 0), 1: (1, 0)}


def test_files_of_a_lost_attempt_go(spark, tmp_path):
    """What a dead task has left is deleted."""
    path = tokens.default_path("byte_bpe_50k.json")
    (tmp_path / "r").mkdir()
    for kind in ("rec", "idx"):
        (tmp_path / "r" / f"part-000000-77.{kind}").write_bytes(b"half a record")
    d = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)], "doc_id long, text string")
    files = records.write_records(d, path, f"file://{tmp_path}/r", 2)
    assert len(list((tmp_path / "r").glob("*.rec"))) == 2 and not list((tmp_path / "r").glob("*-77.*"))
    assert [r.doc_id for r in records.read_files(spark, files).orderBy("start").collect()] == list(range(40))


def test_files_follow_the_bytes_of_texts(spark, tmp_path, monkeypatch):
    assert records.FILE_BYTES == 128 << 20
    monkeypatch.setattr(records, "FILE_BYTES", 2000)
    d = spark.createDataFrame([(i, "some words " * 100) for i in range(40)], "doc_id long, text string")
    assert len(records.write_records(d, tokens.default_path("byte_bpe_50k.json"), f"file://{tmp_path}/s")) > 8


def test_pipeline_end_to_end(spark):
    out = corpus_pipeline.run(spark, DATA)
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).collect()
    assert fill and all(r.n == r.m <= 2048 for r in fill)
