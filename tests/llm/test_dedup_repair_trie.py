"""Exact dedup, conversation repair and the conversation prefix trie against brute force and their SQL."""

import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from signalmart.llm import chat_repair, exact_dedup, prefix_trie
from signalmart.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["op11_exact_dedup", "op12_chat_repair", "op13_prefix_trie"])
def test_registered_against_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[key](spark, SF)
    cur = con.execute(ORACLE[key])
    assert got.columns == [d[0] for d in cur.description]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(cur.fetchall(), key=repr)


# ---------------------------------------------------------------- exact dedup


def some_strings(rng, n):
    return [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.choice((0, 1, 2, 5, 30, 70)))) * rng.choice((1, 1, 3)) for _ in range(n)]


def test_trie_holds_every_string():
    rng = random.Random(11)
    trie, want = exact_dedup.Trie(), {}
    for i, key in enumerate(some_strings(rng, 800)):
        node = trie.reach(key)
        assert (node.owner is None) == (key not in want)
        node.owner = node.owner or i
        want.setdefault(key, i)
    assert {k: n.owner for k, n in trie.strings()} == want
    assert trie.held == trie.weight(trie.root) - exact_dedup.NODE


@pytest.mark.parametrize("mark", [False, True])
def test_trie_spills_subtrees(mark):
    rng = random.Random(12)
    trie, gone, seen = exact_dedup.Trie(), [], []
    for key in some_strings(rng, 600):
        node = trie.reach(key)
        if node.owner is exact_dedup.Trie.SPILLED:
            gone.append(key)
            continue
        node.owner = node.owner or []
        node.owner.append(key)
        if trie.held > 9000:
            for k, n in trie.spill(4500, mark):
                assert all(x == k for x in n.owner)
                gone.extend(n.owner)
        seen.append(key)
    kept = [x for k, n in trie.strings() for x in n.owner]
    assert all(x == k for k, n in trie.strings() for x in n.owner)
    assert kept and sorted(kept + gone) == sorted(some_strings(random.Random(12), 600))
    if mark:
        assert not set(kept) & set(gone)  # a string is settled here or passed on, never both


def brute_groups(rows):
    best, size = {}, {}
    for at, (doc_id, text) in enumerate(rows):
        body = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        order = (-len(text or ""), doc_id is None, doc_id or 0, at)
        size[body] = size.get(body, 0) + 1
        best[body] = min(best.get(body, order), order)
    out = []
    for doc_id, text in rows:
        body = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        keep = best[body]
        out.append((doc_id, None if keep[1] else keep[2], size[body], hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr), len(best)


def odd_documents():
    rng = random.Random(13)
    texts = [None, "", " \n\t", "a b", "ab", "a\x0bb ", "a b", "Ünï cödé", "é", "é", "x" * 50_000, "x" * 50_000 + " ", "x" * 49_999 + "y"]
    texts += [" ".join(rng.choice(("the", "a", "of")) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    rows = [(rng.choice((i, i, None, 7)), rng.choice(texts)) for i in range(400)]
    return rows + [(1000 + i, "the hot text") for i in range(200)] + [(5, "twice"), (5, "twice"), (None, "no id"), (None, "no  id")]


@pytest.mark.parametrize("limits", [{}, {"budget": 3000, "target": 4000, "hot": 2}, {"budget": 1, "target": 40_000, "hot": 10**9}])
def test_exact_groups(spark, limits):
    rows = odd_documents()
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, link int, `a.b` string").repartition(5)
    got = exact_dedup.exact_groups(docs, **limits).collect()
    want, groups = brute_groups(rows)
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "text_sha256")) for r in got), key=repr) == want
    assert sum(r["kept"] for r in got) == groups
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_copies_leave_a_task_as_one_string(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("link"), F.col("id").alias("doc_id"), F.lit(9).cast("long").alias("points"), F.lit(None).cast("long").alias("member"), F.lit(1).cast("long").alias("n"), F.lit(b"same text").alias("body")).repartition(6)
    links, partials = exact_dedup.combine(docs, "copies", 1)
    assert links.count() == 3000 and partials.count() <= 6
    assert links.groupBy("ref").count().agg(F.max("count")).first()[0] <= 1000


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---------------------------------------------------------------- conversation repair


@pytest.mark.parametrize("modulus", [chat_repair.MODULUS, 3])
def test_paths_compare_as_strings(modulus):
    """Also where nearly all hashes collide."""
    rng = random.Random(3)
    paths, texts = chat_repair.Paths(modulus), [""]
    for _ in range(400):
        parent = rng.randrange(max(0, len(texts) - 12), len(texts))
        letter = rng.choice("KKKD")
        assert paths.add(parent, ord(letter)) == len(texts)
        texts.append(texts[parent] + letter)
    for _ in range(3000):
        a, b = rng.randrange(len(texts)), rng.randrange(len(texts))
        assert paths.less(a, b) == (texts[a] < texts[b])
        if len(texts[a]) == len(texts[b]):
            assert paths.equal(a, b) == (texts[a] == texts[b])
        assert paths.spelled(a) == texts[a].encode()


def brute_audit(rows):
    """All edit sequences, inserting at most two turns at a place: the cheapest, least one."""
    best = (10**9, "")
    gaps = ["", "I", "II"]
    for edits in itertools.product(*([gaps] + [[e + g for e in ("DKR" if f not in (1, 2) else "D") for g in gaps] for _, f in rows])):
        audit, at, out, cost = "".join(edits), 0, "", 0
        for e in audit:
            now = "a" if out.endswith("u") else "u"
            if e == "I":
                out, cost = out + now, cost + 3
                continue
            initial, fault = rows[at]
            at += 1
            if e == "D":
                cost += 4
                continue
            cost += 3 * (fault == 3) + 3 * (e == "R")
            if e == "R":
                out += now
            elif initial == now or (initial == "s" and not out):
                out += initial
            else:
                break
        else:
            if not out or (out[-1] == "a"):
                best = min(best, (cost, audit))
    return best


@pytest.mark.parametrize("nodes", [chat_repair.NODES, 6])
def test_audit_is_the_least_of_all(nodes):
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(("s", "u", "a", "t", "")), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(0, 4))]
        audit = chat_repair.Audit(nodes=nodes)
        for row in rows:
            audit.step(*row)
        cost, text = audit.result()
        assert (cost, text.decode()) == brute_audit(rows), rows


def plain_audit(rows):
    """The DP over whole strings."""
    best = {0: (0, ""), 1: (10**9, ""), 2: (3, "I"), 3: (6, "II")}
    for initial, fault in rows:
        found = {s: [(c + 4, t + "D")] for s, (c, t) in best.items()}
        for s, (c, t) in best.items():
            if fault in (1, 2):
                continue
            to, extra = (3 if s == 2 else 2), 3 * (fault == 3)
            found[to].append((c + 3 + extra, t + "R"))
            if initial == " ua"[to - 1]:
                found[to].append((c + extra, t + "K"))
            if initial == "s" and s == 0:
                found[1].append((c + extra, t + "K"))
        best = {s: min(x) for s, x in found.items()}
        best[2] = min(best[2], *((best[s][0] + 3, best[s][1] + "I") for s in (0, 1, 3)))
        best[3] = min(best[3], (best[2][0] + 3, best[2][1] + "I"))
    return min(best[0], best[3])


@pytest.mark.parametrize("nodes", [chat_repair.NODES, 40])
def test_audit_of_long_conversations(nodes):
    rng = random.Random(6)
    for roles, faults in (("sua", (0, 0, 1, 2, 3)), ("ua", (0, 3)), ("t", (1, 2)), ("u", (0,)), ("sst", (3,))):
        rows = [(rng.choice(roles), rng.choice(faults)) for _ in range(300)]
        audit = chat_repair.Audit(nodes=nodes)
        for row in rows:
            audit.step(*row)
        cost, text = audit.result()
        assert (cost, text.decode()) == plain_audit(rows)
        if nodes == 40 and set(faults) & {0}:
            assert len(audit.paths.letter) < 2000  # settled prefixes went


WHITE = " \t\n\x0b\x0c\r"


def brute_repair(turns):
    convs = {}
    for conv, turn, role, text in turns:
        convs.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        order = (turn is not None, turn or 0, role, text)
        if fate == 1:
            text = ""
        elif fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fate == 4:
            role = "user"
        convs[conv].extend([(order, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1))
    out = {}
    for conv, rows in convs.items():
        rows = [r[1:] for r in sorted(rows, key=lambda r: r[0])]
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.rstrip(WHITE)
            faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        numbers = [t for t, _, _ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = plain_audit([(r[1][:1], f) for r, f in zip(rows, faults)])
        lines, at, last = [], 0, ""
        for e in audit:
            row = None if e == "I" else rows[at]
            at += e != "I"
            if e == "D":
                continue
            role = row[1] if e == "K" else ("assistant" if last == "u" else "user")
            last = role[0]
            lines.append(f"{role}:{row[2] if row else ''}")
        out[conv] = (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_turns():
    rng = random.Random(14)
    texts = [None, "", " \n", "Yes.", "No", "Ça va ?\t", "Why?!", "a.b", "x" * 100_000 + "."]
    rows = [(conv, rng.choice((t, t, t, None, 2)), rng.choice(("user", "assistant", "assistant", "system", "tool", "", None, "User")), rng.choice(texts)) for conv in range(60) for t in range(rng.randint(1, 14))]
    rows += [(None, t, ("user", "assistant")[t % 2], f"null {t}.") for t in range(5)] + [(-3, 1, "user", "hi."), (-3, 1, "user", "hi.")]
    return rows + [(90, t, ("user", "assistant")[t % 2], f"long {t}.") for t in range(700)] + [(91, None, "user", "same.")] * 300


def test_repair(spark, monkeypatch):
    monkeypatch.setattr(chat_repair, "PART", 64)
    rows = odd_turns()
    turns = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, `fault.x` string").repartition(7)
    damaged = chat_repair.damaged(turns)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_repair.repair(damaged, turns).collect()}
    assert got == brute_repair(rows)
    faulty = chat_repair.with_faults(damaged)
    steps = chat_repair.apply_audits(faulty, chat_repair.audits(faulty)).filter("step is not null").collect()
    lines = {}
    for r in sorted(steps, key=lambda r: r["step"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, row in got.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == row[-1]


def test_repair_of_sound_turns(spark):
    turns = spark.createDataFrame([(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hi!")], "conv_id long, turn long, role string, text string")
    row = chat_repair.repair(chat_repair.in_order(turns)).first()
    assert (row["cost"], row["audit"], row["illegal"]) == (0, "KKK", 0)


def test_repair_of_nothing(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_repair.repair(chat_repair.damaged(turns), turns).collect() == []


# ---------------------------------------------------------------- prefix trie


def brute_trie(turns):
    convs = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [r[2:] for r in sorted(rows)] for c, rows in convs.items()}
    nodes = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(convs.get(c - c % 5, [])[:h] + convs[c][h:])
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], ([], []))[0].append(c)
        nodes[whole][1].append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)

    def below(key):
        saved = (len(nodes[key][0]) - 1) * len(key[-1][1].encode()) if key else 0
        leaves = 0 if key in children else 1
        for child in children.get(key, []):
            s, n = below(child)
            saved, leaves = saved + s, leaves + n
        return saved, leaves

    out = []
    for key, (members, ends) in nodes.items():
        saved, leaves = below(key)
        sha = hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()
        out.append((min(members), len(key), min(nodes[key[:-1]][0]) if key else None, len(members), len(children.get(key, [])), leaves, saved, sha))
    return sorted(out, key=repr)


def nested_turns():
    rng = random.Random(15)
    rows = [(c, t, ("user", "assistant")[t % 2], rng.choice(("one", "two", "drei é"))) for c in range(120) for t in range(rng.randint(1, 6)) if c not in (10, 25)]
    rows += [(c, None, "user", None) for c in range(0, 30, 3)] + [(c, 0, None, "") for c in range(1, 30, 3)]
    rows += [(c, t, "user", "same") for c in range(200, 320) for t in range(2)]  # a hot conversation
    return rows + [(41, 1, "user", "tie")] * 3 + [(None, 0, "user", "x")] + [(400, None, "user", "again")] * 60 + [(401, t, "user", "again") for t in range(90)]


@pytest.mark.parametrize("stretch", [prefix_trie.STRETCH, 4])
def test_prefix_trie(spark, monkeypatch, stretch):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    rows = nested_turns()
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, `p1.x` string").repartition(6)
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.placed_turns(turns)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_prefix_trie_of_nothing(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.placed_turns(turns))).collect() == []


def test_places_of_one_hot_conversation(spark):
    """Turns without numbers are still dealt over tasks, and numbered without gaps."""
    turns = spark.range(4000).select(F.lit(1).alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    placed = prefix_trie.placed_turns(turns)
    assert sorted(r[0] for r in placed.select("place").collect()) == list(range(1, 4001))


def test_collisions_are_seen(spark):
    schema = "depth long, h1 long, h2 long, p1 long, p2 long, d1 long, d2 long, d3 long, d4 long"
    same = [(1, 5, 5, 0, 0, 1, 2, 3, 4)] * 2
    assert not prefix_trie.collides(spark.createDataFrame(same, schema))
    assert prefix_trie.collides(spark.createDataFrame([*same, (1, 5, 5, 0, 0, 1, 2, 3, 9)], schema))
    assert prefix_trie.collides(spark.createDataFrame([*same, (1, 5, 5, 0, 1, 1, 2, 3, 4)], schema))
