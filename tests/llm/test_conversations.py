"""Repair and prefix trie of conversations, and token files: brute force and odd input."""

import hashlib
import itertools
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quoin.llm import repair, tokenfiles, trie, urls
from quoin.llm.bpe import vocabulary

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def talk(rng, convs, most, texts, ids=None):
    rows = []
    for c in ids or range(convs):
        for t in range(rng.randint(1, most)):
            rows.append((c, t * rng.choice([1, 1, 1, 2]), rng.choice(["user", "assistant", "system", "user", "assistant"]), rng.choice(texts)))
    return rows


# ── repair ─────────────────────────────────────────────────────────────────


def cheapest(initials, faults):
    """Least cost and least letters by trying every edit, row by row, all states kept."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        changed = True
        while changed:
            changed = False
            for last, (cost, letters) in list(best.items()):
                for role in "ua":
                    to = step.get((last, role))
                    if to and (cost + 5, letters + "I") < best.get(to, (1 << 40, "")):
                        best[to] = (cost + 5, letters + "I")
                        changed = True
        return best

    best = inserted({"": (0, "")})
    for initial, fault in zip(initials, faults):
        new = {}
        for last, (cost, letters) in best.items():
            tries = [(last, 2, "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                tries += [(step.get((last, initial)), more, "K")] + [(step.get((last, r)), 1 + more, "R") for r in "ua"]
            for to, more, letter in tries:
                if to is not None and (cost + more, letters + letter) < new.get(to, (1 << 40, "")):
                    new[to] = (cost + more, letters + letter)
        best = inserted(new)
    return min(best[last] for last in ("", "a") if last in best)


def repaired_by_hand(rows):
    out = {}
    for c in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            name = lambda x: " " if x is None else str(x)
            case = zlib.crc32(f"{name(c)}:{name(turn)}".encode()) % 20
            role, text = name(role), name(text)
            if case == 0:
                continue
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            left += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in left:
            bare = "".join(WORD.findall(text))
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in left]
        cost, audit = cheapest(initials, faults)
        turns = {r[0] for r in left if r[0] is not None}
        said, at = [], iter(left)
        for letter in audit:
            to = "assistant" if said and said[-1].startswith("u") else "user"
            row = next(at) if letter != "I" else (None, to, "")
            if letter != "D":
                said.append(f"{row[1] if letter == 'K' else to}:{row[2]}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_lattice_equals_trying_all_edits():
    rng = random.Random(11)
    names = ["", "blank", "duplicate", "truncated"]
    for _ in range(3000):
        n = rng.randint(0, 9)
        initials, faults = [rng.choice(["u", "a", "s", "x", "", "u", "a"]) for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        assert repair.Lattice(initials, faults).solve() == cheapest(initials, [names[f] for f in faults])


@pytest.mark.parametrize("n", [15, 16, 17, 33, 700])
def test_lattice_of_long_conversations(n):
    rng = random.Random(n)
    initials, faults = [rng.choice("uuaas") for _ in range(n)], [rng.choice([0, 0, 1, 2, 3, 3]) for _ in range(n)]
    assert repair.Lattice(initials, faults).solve() == cheapest(initials, [["", "blank", "duplicate", "truncated"][f] for f in faults])


def test_repair_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in repair.op11_repair(spark, sf_dir).collect()}
    assert got == repaired_by_hand(rows) and sum(r[5] > 0 for r in got.values()) > len(got) / 3


def test_repair_on_odd_input(spark):
    rng = random.Random(3)
    rows = talk(rng, 60, 12, ["One.", "Two!", "three", "", " \n\t", "Four? ", "five. ", "é.", "x" * 50_000 + "."])
    rows += [(None, 1, "user", "No id."), (None, None, None, None), (70, None, "user", "Null turn."), (70, None, "assistant", "Null too."), (70, 4, None, "No role."), (71, 2, "", "Empty role."), (71, 2, "user", "Same turn."), (71, 2, "user", "Same turn."), (72, 5, "tool", "Other role.")]
    rows += [(73, t, "user", "Gone.") for t in range(2000) if zlib.crc32(f"73:{t}".encode()) % 20 == 0]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("phase", "fault", "gone", "copy", "cost")})
    got = {r[0]: tuple(r[1:]) for r in repair.repaired(repair.damaged(frame)).collect()}
    assert got == repaired_by_hand(rows) and None in got
    assert got[73] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repaired(repair.damaged(frame.limit(0))).count() == 0


# ── trie ───────────────────────────────────────────────────────────────────


def spark_hash(role, text):
    x = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(role.encode(), 42))
    return x - (1 << 64) if x >> 63 else x


def trie_by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], spark_hash(*r[1:])))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(r[1:] for r in own.get(c - c % 20, [])[:h] + turns[h:])
    nodes = {}
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            nodes.setdefault(made[c][:d], []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        child = lambda k: [x for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k]
        saved = sum((len(nodes[k]) - 1) * len(WORD.findall(k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in members if made[c] == key)
        out.append((members[0], len(key), nodes[key[:-1]][0] if key else None, len(members), len(child(key)), sum(not child(k) for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes_of(frame):
    return sorted((tuple(r) for r in trie.trie(frame).collect()), key=str)


@pytest.mark.parametrize("block, segment, run_ids", [(4, 1024, 65536), (2, 4, 3), (1, 2, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, block, segment, run_ids):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "RUN_IDS", run_ids)
    rng = random.Random(block)
    rows = [(c, t, role, text) for c, t, role, text in talk(rng, 45, 7, ["a b", "c", ""], [*range(0, 20), 21, 22, 25, 40, 43, 100, 101, 119])]
    rows += [(c, t, "user", f"long {t % 3}") for c in (200, 201, 202) for t in range(40)]  # few turns of them differ
    assert nodes_of(spark.createDataFrame(rows, SCHEMA)) == trie_by_hand(rows)


def test_trie_on_odd_input(spark):
    rows = [(7, None, None, None), (7, None, "user", "x y"), (7, 1, "user", None), (7, 1, "user", None), (None, 1, "user", "no conversation"), (3, 5, "assistant", "w " * 20_000), (0, 1, "user", "x y"), (27, 2, "user", "turnless? no")]
    rows += [(c, 0, "user", "only one") for c in range(40, 60)]  # some lose their only turn and take none or the first one's
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("a", "b", "pos", "part", "x", "depth")})
    assert nodes_of(frame) == trie_by_hand(rows)
    assert nodes_of(frame.limit(0)) == []
    with pytest.raises(TypeError):
        trie.trie(frame.withColumn("conv_id", F.lit("c")))


def test_a_conversation_over_many_tasks_is_numbered_in_order(spark):
    rows = [(1, t % 500, "user", str(t)) for t in range(3000)] + [(c, t, "user", "x") for c in (0, 2, 3) for t in range(5)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(8)
    placed = trie.numbered(trie.digested(frame)).groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("z"))
    assert sorted(tuple(r) for r in placed.collect()) == [(0, 5, 5, 1, 5), (1, 3000, 3000, 1, 3000), (2, 5, 5, 1, 5), (3, 5, 5, 1, 5)]


# ── token files ────────────────────────────────────────────────────────────

ODD_TEXTS = [None, "", " \n ", "Plain words, 10 times 0.", "A<|endoftext|>b <|startoftext|>", "İstanbul ΑΣ ǰ J̌ é́", "a b c d", "'s don't WE'LL", "日本語のテキスト 東京0", "\x1c\x1d0\x00", "word " * 30_000, "x" * 100_000, "same", "same"]


def library(texts):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(vocabulary())
    return [tokens.encode(t or "", add_special_tokens=False).ids + [tokenfiles.END_ID] for t in texts]


@pytest.mark.parametrize("file_ids, block_ids", [(8_000_000, 500_000), (20_000, 900), (100, 1)])
def test_token_files_give_back_what_the_library_encodes(spark, tmp_path, monkeypatch, file_ids, block_ids):
    monkeypatch.setattr(tokenfiles, "FILE_IDS", file_ids)
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", block_ids)
    ids = [9, 3, None, 5, 1, 1, 4, 8, 7, 6, 2, 12, 30, 30]
    frame = spark.createDataFrame(list(zip(ids, ODD_TEXTS, itertools.repeat("own"))), "doc_id long, text string, n string").repartition(3)
    tokenfiles.write(frame, str(tmp_path / "t"), vocabulary())
    rows = sorted(tokenfiles.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    want = dict(enumerate(library(ODD_TEXTS)))
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 30, 30]
    at = 0
    for r in rows:
        found = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(found)
        assert found in [want[k] for k in range(len(ids)) if ids[k] == r.doc_id]
        at += len(found)
    ranks = spark.read.parquet(str(tmp_path / "t/ranks")).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(len(ranks))) and sum(r.n for r in ranks) == at
    assert [r.n for r in ranks] == sorted((r.n for r in ranks), reverse=True)
    index = spark.read.parquet(str(tmp_path / "t/index"))
    assert index.agg(F.sum("n_docs"), F.sum("n_ids")).first() == (len(ids), at)
    tokenfiles.write(frame.limit(0), str(tmp_path / "none"), vocabulary())
    assert tokenfiles.read(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(TypeError):
        tokenfiles.write(frame.withColumn("doc_id", F.lit("d")), str(tmp_path / "x"), vocabulary())


def test_token_query_equals_brute_force(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want, at = [], 0
    for (i, _), found in zip(docs, library([t for _, t in docs])):
        want.append((i, at, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        at += len(found)
    assert sorted(tuple(r) for r in tokenfiles.op12_token_files(spark, sf_dir).collect()) == want


@pytest.mark.parametrize("bits, most", [(1, 1 << 16), (2, 1 << 16), (2, 1 << 32)])
def test_code_round_trip(bits, most):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 3, 4, 7, 8, 9, 1000):
        ranks = (rng.random(n) ** 8 * most).astype(np.uint32)
        control, data = tokenfiles.pack(ranks, bits)
        assert len(control) == -(-n // (8 // bits)) and len(data) == sum(max(1, (int(r).bit_length() + 7) // 8) for r in ranks)
        assert tokenfiles.unpack(np.frombuffer(control, "u1"), np.frombuffer(data, "u1"), n, bits).tolist() == ranks.tolist()
    with pytest.raises(ValueError):
        tokenfiles.pack(np.array([1 << 16], np.uint32), 1)


def test_damaged_files_are_refused():
    import pyarrow as pa

    one = tokenfiles.block(pa.array([1, None], pa.int64()), np.array([2, 1]), np.array([0, 300, 5]), 1) + tokenfiles.MARK.encode()
    assert len(list(tokenfiles.blocks(one + one))) == 2
    for bad in (b"x" + one, one[:-1], one + b"tail that is no block at all, of some length"):
        with pytest.raises((ValueError, struct.error)):
            list(tokenfiles.blocks(bad))


# ── url rules as stated ────────────────────────────────────────────────────


def test_url_rules_as_stated(spark):
    cases = {
        "http://a.com/en/x": ("com/en/", "block"),
        "http://example.com/en/7": ("example.com/en/7", "allow"),
        "https://b.net/de/1": ("net/de/", "allow"),
        "https://www.example.net/de/8": ("example.net/de/8", "block"),
        "https://org/es/": ("org/es/", "block"),
        "https://a.org/de/": (None, "allow"),
        "https://casino-win.example.net/de/": ("net/de/", "allow"),
        "https://casino-win.example.net/": (None, "block"),
    }
    rows = urls.judge(spark.createDataFrame([(u,) for u in cases], "url string"), urls.RULES, urls.LISTED).collect()
    assert {r.url: (r.rule, r.verdict) for r in rows} == cases
