"""Operators over whole tables against brute force: line dedup, SimHash, embeddings, chats, components, classifier, pipeline."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from signalmart.llm import chat, embedding_dedup, line_dedup, quality, simhash
from signalmart.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def parts(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("kind", ["random", "path", "star"])
def test_components(spark, kind):
    rng, n = random.Random(4), 300
    links = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(220)], "path": [(i, i + 1) for i in range(n - 1)], "star": [(7, i) for i in range(n)]}[kind]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (5, None)], "a long, b long")).collect()}
    want = parts(n, links)
    assert got == {x: want[x] for a, b in links for x in (a, b) if a != b}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprint():
    rng = random.Random(6)
    texts = [None, "", " \n", "One", "one two", "É é\x0bA\x1cb c"] + [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 60))) for _ in range(100)]
    assert [simhash.fingerprint(t, 3) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_hamming_anchors_cover():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 31, 500)
    home = simhash.home_anchors(words)
    assert (np.bitwise_count(home ^ words) <= 1).all() and (simhash.home_anchors(home) == home).all()
    near = simhash.anchors_within_two(words)
    assert (np.bitwise_count(near ^ words[:, None]) <= 2).all()
    for word, anchors in zip(words, near):
        flipped = word ^ (1 << rng.integers(0, 31))
        assert simhash.home_anchors(np.array([flipped]))[0] in anchors


def test_close_pairs(spark):
    rng = random.Random(8)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (0, 1, 2, 3, 4)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    for distance in (0, 1, 2, 3):
        got = {(r["a"], r["b"]) for r in simhash.close_pairs(table, distance).collect()}
        assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= distance}


def test_near_duplicates(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        words = [rng.choice(["ab", "cd", "Ef", "gh", "xyz"]) for _ in range(200)]
        texts += [" ".join(words), " ".join(words[:-1]), " ".join(words).upper()]
    texts += [None, "", " ", "one"]
    ids = list(range(len(texts)))
    rows = [(i, t, "x") for i, t in zip(ids, texts)] + [(3, texts[3], "again"), (None, texts[5], "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    fps = [brute_fingerprint(t) for t in texts]
    want = parts(len(texts), [(a, b) for a in ids for b in ids if bin(fps[a] ^ fps[b]).count("1") <= 2])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_decides_per_row(spark):
    rng = random.Random(10)
    a, b, c, d, e = (" ".join(rng.choice(["ab", "cd", "Ef", "gh", "xyz"]) for _ in range(200)) for _ in range(5))
    schema = "doc_id long, text string, n int"
    cases = [
        # the copy of 3 goes, the other text of 5 stays
        ([(3, a.upper(), 1), (5, a, 1), (5, b, 1)], [(3, a.upper(), 1), (5, b, 1)]),
        # a copy without an id goes, unique texts without ids stay
        ([(1, a, 1), (None, a, 1), (None, b, 1), (None, c, 1)], [(1, a, 1), (None, b, 1), (None, c, 1)]),
        # no copies: different texts without ids and under one id all stay
        ([(None, a, 1), (None, b, 1), (7, c, 1), (7, d, 1), (8, e, None)], [(None, a, 1), (None, b, 1), (7, c, 1), (7, d, 1), (8, e, None)]),
        # rows equal throughout stay once, with and without an id
        ([(4, a, 1), (4, a, 1), (None, b, 1), (None, b, 1), (None, None, 1)], [(4, a, 1), (None, b, 1), (None, None, 1)]),
    ]
    for rows, want in cases:
        got = simhash.keep_one(spark.createDataFrame(rows, schema))
        assert got.columns == ["doc_id", "text", "n"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    # one of the rows that differ only beside id and text stays
    assert simhash.keep_one(spark.createDataFrame([(4, a, 1), (4, a, None), (4, a, 2)], schema)).count() == 1


# ---------------------------------------------------------------- lines


def brute_lines(docs, min_tokens=5):
    """The kept text of each document; docs: distinct (id, text)."""
    seen, kept = [], {}
    for i, text in sorted(docs, key=lambda d: -1 if d[0] is None else d[0]):
        out = []
        for line in (text or "").split("\n"):
            words = {w for w in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if w}
            hit = any(words == o or (min(len(words), len(o)) >= min_tokens and 5 * len(words & o) >= 4 * len(words | o)) for o in seen)
            if words:
                seen.append(words)
            if not hit:
                out.append(line)
        kept[i] = "\n".join(out)
    return kept


@pytest.mark.parametrize("hot_class", [line_dedup.HOT_CLASS, 0])
def test_line_dedup(spark, monkeypatch, hot_class):
    monkeypatch.setattr(line_dedup, "HOT_CLASS", hot_class)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "of"] * 3
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 5, 8, 20, 40]))) for _ in range(60)]

    def varied(line):
        words = line.split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return rng.choice([" ", "  ", "\t"]).join(words)

    docs = [(i, "\n".join(varied(rng.choice(lines)) for _ in range(rng.randint(0, 12)))) for i in range(50)]
    docs += [(60, None), (61, ""), (62, "\n\n"), (63, "a b c d e\r\nA  B C D E"), (None, "a b c d e\nnew words in this line"), (64, "long " + " ".join(f"q{i}" for i in range(3000)))]
    table = spark.createDataFrame([(i, t, "x", len(t) if t else 0, 1) for i, t in docs], "doc_id long, text string, lines string, n_chars long, n int")
    got = line_dedup.dedup_lines(table, length_col="n_chars")
    assert got.columns == table.columns
    want = brute_lines(docs)
    for row in got.collect():
        assert (row["text"] or "") == want[row["doc_id"]]
        assert row["text"] is None or row["n_chars"] == len(row["text"])
    digest = {r["doc_id"]: r for r in line_dedup.summary(table).collect()}
    assert all(digest[i]["n_lines"] == (len(t.split("\n")) if t is not None else 0) for i, t in docs)


def test_line_dedup_of_long_lines(spark):
    """Around and above the width of the bitmaps: lines near and not so near the threshold."""
    rng = random.Random(12)
    docs = []
    for i, n in enumerate([90, 94, 96, 100, 130, 250, 700] * 3):
        words = rng.sample([f"v{j}" for j in range(900)], n)
        variants = [words]
        for share in (0.02, 0.09, 0.1, 0.11, 0.13, 0.3):
            varied = list(words)
            for at in rng.sample(range(n), int(share * n)):
                varied[at] = rng.choice((f"x{i}-{at}", f"v{rng.randrange(900)}"))
            variants.append(varied[: n - rng.randint(0, 6)])
        docs.append((i, "\n".join(" ".join(rng.sample(v, len(v))) for v in variants)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_lines(docs)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table).collect()}
    assert got == want and 0 < sum(t.count("\n") for t in got.values()) < 6 * len(docs)


def test_line_dedup_of_near_copies_close_to_the_threshold(spark):
    """In a group of near copies the filters pass every similar pair and few others, though the lines fill a bitmap of 64 bits."""
    rng = random.Random(13)
    base = [f"b{i}" for i in range(60)]
    lines = [[w if at not in gone else f"x{i}-{at}" for at, w in enumerate(base)] for i in range(60) for gone in [rng.sample(range(60), rng.randint(3, 6) if i else 12)]]
    docs = [(i, " ".join(words)) for i, words in enumerate(lines)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table).collect()} == brute_lines(docs)
    rows = line_dedup.tokenised(line_dedup.exploded(table), line_dedup.rarity(table), 800, 1000, 5).selectExpr("doc_id as id", "n", "0 as pos", "bits", "bits2")
    pairs = rows.join(rows.selectExpr(*(f"{c} as p_{c}" for c in rows.columns)), F.expr("p_id < id"))
    passed = {(r["p_id"], r["id"]) for r in pairs.filter(line_dedup._may_match("", "p_", 800, 1000)).collect()}
    every = {(a, b) for b in range(60) for a in range(b)}
    similar = {(a, b) for a, b in every if 1000 * len({*lines[a]} & {*lines[b]}) >= 800 * len({*lines[a]} | {*lines[b]})}
    assert 100 < len(similar) and similar <= passed and 2 * len(passed - similar) < len(every - similar)


def test_line_dedup_tells_documents_without_id_apart(spark, monkeypatch):
    """Texts of null ids are documents of their own, also where the short hash of their texts is the same."""
    real = line_dedup.part_of
    monkeypatch.setattr(line_dedup, "part_of", lambda text="text": real(text) * 0)
    docs = [(None, f"alone {i} in the world here\nsaid by all the very same") for i in range(40)]
    table = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, `a.b` int, __lines string")
    got = line_dedup.dedup_lines(table)
    assert got.columns == table.columns
    texts = [r["text"] for r in got.collect()]
    assert sum("same" in t for t in texts) == 1 and all(t.startswith("alone") for t in texts) and len(set(texts)) == 40


def test_line_dedup_repeated_rows_and_empty_table(spark):
    table = spark.createDataFrame([(1, "a b c d e\nx"), (1, "a b c d e\nx"), (2, "e d c b a")], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.dedup_lines(table).collect()) == ["", "a b c d e\nx", "a b c d e\nx"]
    assert line_dedup.dedup_lines(table.limit(0)).count() == 0


# ---------------------------------------------------------------- embeddings


def test_dual_traversal(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(25):
        n, d = int(rng.integers(2, 300)), int(rng.integers(2, 20))
        centres = rng.normal(size=(int(rng.integers(1, 8)), d))
        x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, d)) * rng.choice([0.01, 0.05, 0.2, 1])
        x /= np.linalg.norm(x, axis=1)[:, None]
        w = rng.integers(1, 4, n)
        for leaf, strip in ((2, 7), (16, 512)):
            monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
            monkeypatch.setattr(embedding_dedup, "STRIP", strip)
            for split in (0, int(rng.integers(1, n))):
                found = embedding_dedup.dual_traversal(x, w, split, 0.98)
                close = x @ x.T >= 0.98
                np.fill_diagonal(close, False)
                if split:
                    close[:split, :split] = close[split:, split:] = False
                assert (found.counts == close @ w).all()
                assert found.roots().tolist() == parts(n, np.argwhere(close).tolist())


def test_cover_tree_has_levels():
    """Covering radii halve, centres stay apart, each vector is in one child; clusters come apart level by level."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, 12))
    for spread in (0.5, 0.15, 0.04, 0.01):
        x = np.repeat(x, 5, axis=0) + rng.normal(size=(5 * len(x), 12)) * spread
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = embedding_dedup.CoverTree(x, 0.02)
    assert tree.levels >= 5
    stack = [tree.root]
    while stack:
        node = stack.pop()
        away = embedding_dedup.distances(x[node.members] @ x[node.centre])
        assert away.max() <= node.radius + 1e-6
        if node.children:
            assert sorted(m for c in node.children for m in c.members.tolist()) == sorted(node.members.tolist())
            assert node.children[0].centre == node.centre and all(c.radius <= node.radius / 2 + 1e-9 for c in node.children)
            apart = embedding_dedup.distances(x[[c.centre for c in node.children]] @ x[[c.centre for c in node.children]].T)
            np.fill_diagonal(apart, 9)
            assert apart.min() > node.radius / 2
            stack.extend(node.children)


def test_walk_prunes_the_given_vectors():
    """On the largest label of the table: levels there are, and nearly all pairs fall as pairs of nodes."""
    import duckdb

    path = "/root/testdata/sf0.1/embeddings.parquet"
    label = duckdb.sql(f"SELECT label FROM '{path}' WHERE label IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1").fetchall()[0][0]
    x = np.array([r[0] for r in duckdb.execute(f"SELECT embedding FROM '{path}' WHERE label = ?", [label]).fetchall()], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert embedding_dedup.CoverTree(x, 0.2).levels > 1
    links = embedding_dedup.dual_traversal(x, np.ones(len(x), np.int64), 0, 0.98)
    assert links.compared + links.accepted < 0.05 * len(x) ** 2
    assert (links.counts == (x @ x.T >= 0.98).sum(axis=1) - 1).all()


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 10])
def test_embedding_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    x = (base[rng.integers(0, 12, 150)] + rng.normal(size=(150, 8)) * rng.choice([0.02, 0.1, 0.6], 150)[:, None]).astype(float)
    x[10:20] = x[9]
    x[20] = 3 * x[9]
    vectors = [[float(v) for v in row] for row in x] + [None, [0.0] * 8, [float("nan")] * 8, [None] + [1.0] * 7, [1.0, 2.0], [], [2.0, 4.0]]
    labels = [int(i % 3 == 0) for i in range(150)] + [0] * 7
    labels[5] = labels[6] = None
    rows = [(i, v, lab, 9) for i, (v, lab) in enumerate(zip(vectors, labels))]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = [(a, b) for a in range(150) for b in range(150) if a != b and labels[a] is not None and labels[a] == labels[b] and unit[a] @ unit[b] >= 0.98]
    links += [(154, 156), (156, 154)]
    want = parts(157, links)
    for i in range(157):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (sum(a == i for a, _ in links), want[i], want[i] == i)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert embedding_dedup.near_duplicates(empty).count() == 0


# ---------------------------------------------------------------- chats


@pytest.mark.parametrize("stretch,part", [(chat.STRETCH, chat.PART), (2, 3)])
def test_chat(spark, monkeypatch, stretch, part):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    monkeypatch.setattr(chat, "PART", part)
    rng, rows = random.Random(12), []
    logs = {}
    for conv in range(40):
        n = rng.randint(1, 8)
        logs[conv] = [(rng.choice(["user", None]), rng.choice(["a", "b", None])) for _ in range(n)]
        if conv % 3 == 0 and conv:
            other = logs[rng.randrange(conv)]
            logs[conv] = other[: rng.randint(1, len(other))] + ([] if conv % 2 else [("user", "more")])
    for conv, turns in logs.items():
        rows += [(conv, 10 * k - 5, r, t, "x") for k, (r, t) in enumerate(turns)]
    rows += [(None, 1, "user", "lost", "x")]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    kept = [c for c, t in logs.items() if not any((len(o) > len(t) or (o == t and k < c)) and o[: len(t)] == t for k, o in logs.items() if k != c)]
    got = {}
    for r in sorted(chat.format_chats(table).collect(), key=lambda r: (r["conv_id"], r["part"])):
        assert r["n_turns"] <= part
        got[r["conv_id"]] = got.get(r["conv_id"], "") + r["rendered"]
    assert got == {c: "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in logs[c]) for c in kept}
    assert chat.format_chats(table.limit(0)).count() == 0


def test_chat_repeated_turns_and_null_turns(spark):
    rows = [(1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, "system", "s"), (2, None, "system", "s"), (2, 1, "user", "a")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(1, 3)]


def test_chat_tells_a_null_role_from_a_null_text(spark):
    rows = [(1, 1, None, "x"), (2, 1, "x", None), (3, 1, "x", None), (3, 2, "user", "more"), (4, 1, None, "x"), (5, 1, None, None), (6, 1, "", None)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    # 4 repeats 1 and 3 continues 2, nothing else is equal
    assert sorted((r["conv_id"], r["n_turns"]) for r in got) == [(1, 1), (3, 2), (5, 1), (6, 1)]


# ---------------------------------------------------------------- classifier and pipeline


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.97 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def brute_features(text, bits):
    """{bucket: value} by plain counting."""
    import re

    top, same, step = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0x100000001B3
    surfaces, shapes = [], []
    for word in (text or "").split():
        shape = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a", word)
        shape = re.sub(r"([^\w\s])\1{2,}", r"\1\1", re.sub(r"\d+", "0", shape))
        surfaces.append(xxhash.xxh64_intdigest(word.lower().encode(), 0))
        shapes.append(xxhash.xxh64_intdigest(shape.encode(), 1))
    shapes = [same if i and surfaces[i] == surfaces[i - 1] else s for i, s in enumerate(shapes)]
    grams = list(surfaces) + [(a * step + b) & top for a, b in zip(surfaces, surfaces[1:])] + [s ^ same for s in shapes]
    pairs = [(a * step + b) & top for a, b in zip(shapes, shapes[1:])]
    grams += [p ^ (same >> 1) for p in pairs] + [(p * step + s) & top for p, s in zip(pairs, shapes[2:])]
    counts = {}
    for g in grams:
        g ^= g >> 29
        bucket = ((g * step) & top) >> (64 - bits)
        if bucket:
            counts[bucket] = counts.get(bucket, 0) + 1
    logs = {b: float(np.log1p(c)) for b, c in counts.items()}
    norm = sum(v * v for v in logs.values()) ** 0.5
    return {0: 1.0} | {b: v / norm for b, v in logs.items()}


def test_quality_against_plain_arithmetic(spark):
    """Features, updates and scores written out in scalars."""
    rng = random.Random(21)
    settings = quality.Settings(bits=12, min_updates=900)
    words = ["Good", "good", "BAD", "x1", "!!!!", "a,b", "the", "Ünï", "2024"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for i in range(90)}
    labels = {i: int("BAD" not in t) for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()) + [(4, "another document of this id")], "doc_id long, text string")
    table = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    learn = [i for i in texts if zlib.crc32(str(i).encode()) % 3 != 1]
    chosen = {i: texts[i] for i in learn}
    if 4 in chosen:  # of an id's documents the one with the least hash is learned from
        chosen[4] = docs.filter("doc_id = 4").orderBy(F.xxhash64("text"), "text").first()["text"]
    z, n = {}, {}

    def w(b):
        l1 = settings.l1 if b else 0.0
        sign = int(z.get(b, 0.0) > 0) - int(z.get(b, 0.0) < 0)
        return -sign * max(abs(z.get(b, 0.0)) - l1, 0.0) / ((settings.beta + n.get(b, 0.0) ** 0.5) / settings.alpha + settings.l2)

    examples = [(brute_features(chosen[i], settings.bits), labels[i]) for i in sorted(learn, key=lambda i: (zlib.crc32(str(i).encode()), i))]
    for _ in range(-(-settings.min_updates // len(learn))):
        for found, label in examples:
            weights = {b: w(b) for b in found}
            slope = 1 / (1 + np.exp(-sum(weights[b] * v for b, v in found.items()))) - label
            for b, v in found.items():
                g = slope * v
                grown = n.get(b, 0.0) + g * g
                z[b] = z.get(b, 0.0) + g - (grown**0.5 - n.get(b, 0.0) ** 0.5) / settings.alpha * weights[b]
                n[b] = grown
    weight = {b: w(b) for b in z}
    got = quality.train(docs, table, settings)
    assert np.allclose([got[b] for b in weight], list(weight.values()), atol=1e-9)
    assert set(np.flatnonzero(got)) <= set(weight)
    scored = {(r["doc_id"], r["score"]) for r in quality.score(docs, got, settings.bits).collect()}
    for i, score in scored:
        text = texts[i] if i != 4 else None
        if text is not None:
            dot = sum(weight.get(b, 0.0) * v for b, v in brute_features(text, settings.bits).items())
            assert abs(score - 1 / (1 + np.exp(-dot))) < 1e-8


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(0, "good plain words", 1.0), (2, "BAD!! BAD!!", 0.0), (None, None, 0.0), (4, "", 0.0), (4, "x " * 50000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(0, 1), (2, 0), (2, 1), (4, None), (4, 7), (99, 1), (None, 0)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    unlabelled = quality.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_pipeline_stages(spark):
    """Each stage against what its operator says of the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "encode"]

    first = stages["quality"](spark, docs, SF).cache()
    good = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1")
    assert first.columns == columns and {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in good.collect()}

    second = stages["line_dedup"](spark, first, SF).cache()
    want = brute_lines([(r["doc_id"], r["text"]) for r in first.collect()])
    assert second.columns == columns and {r["doc_id"]: r["text"] or "" for r in second.collect()} == want

    third = stages["near_dedup"](spark, second, SF).cache()
    rows = second.collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    label = parts(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2])
    least = {}
    for r, c in zip(rows, label):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert third.columns == columns and {r["doc_id"] for r in third.collect()} == set(least.values())

    fourth = stages["decontaminate"](spark, third, SF).cache()
    assert fourth.columns == columns and fourth.count() <= third.count()
    last = stages["encode"](spark, fourth, SF)
    assert last.filter("exact").count() == last.count() == fourth.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, last.collect()))
    for cached in (first, second, third, fourth):
        cached.unpersist()
