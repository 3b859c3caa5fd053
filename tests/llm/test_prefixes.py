"""The prefix trie against plain dictionaries of prefixes, on cut trees and bands."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wayfold.llm import prefixes

SCHEMA = "conv_id long, turn int, role string, text string, pos string, n long, band string, kind string, k1 string"


def brute(seqs):
    """conv_id -> list of (role, text)."""
    nodes = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[b] for b in below) or 1
        saved[path] = sum(saved[b] for b in below) + (len(nodes[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items())


def result(found):
    nothing = hashlib.sha256(b"").hexdigest()
    rows = found.nodes.join(prefixes.end_digests(found.ends), ["k1", "k2"], "left").collect()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"] or nothing) for r in rows)


def ordered(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            by[c].append((turn is not None, turn or 0, key, role, text))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["hi", "yes é", "no"])))
    rows += [(100 + c, t, "user", f"same {t}") for c in range(25) for t in range(7)]
    rows += [(200, t, "user", f"long {t % 2}") for t in range(40)] + [(201, t, "user", f"long {t % 2}") for t in range(31)]
    odd = [(300, None, None, None), (300, None, "user", "a"), (300, 1, None, "b"), (300, 1, "b", None), (300, 1, "b", None), (301, 0, "", ""), (302, 0, None, ""), (None, 0, "user", "lost"), (303, 0, "ab", "c"), (304, 0, "a", "bc"),
           (305, 0, "user", "x" * 300000)]
    rows += odd
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 7, None, "k", "") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("band, shard", [(2, 6), (7, 40), (1024, 25), (1024, 1 << 15)])
def test_equals_plain_prefixes(spark, band, shard):
    rows = conversations(band)
    turns = prefixes.numbered(frame(spark, rows))
    want = brute(ordered(rows))
    assert result(prefixes.tries(turns, turns.select("conv_id").distinct(), band, shard)) == want


def test_rebuilt_openings(spark):
    rows = [r for r in conversations(3) if r[0] is None or r[0] % 5 or r[0] < 200]  # some openings are absent
    rows = [r for r in rows if r[0] not in (10, 15)] + [(-7, 0, "user", "below"), (-5, 0, "user", "zero")]
    own = ordered(rows)
    want = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        want[c] = own.get(base, [])[:h] + own[c][h:]
    turns = prefixes.numbered(frame(spark, rows))
    again, ids = prefixes.rebuilt(turns, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9)
    assert any(not s for s in want.values())
    assert result(prefixes.tries(again, ids, 4, 10)) == brute(want)


def test_no_conversations(spark):
    turns = prefixes.numbered(spark.createDataFrame([], SCHEMA))
    assert result(prefixes.tries(turns, turns.select("conv_id").distinct())) == []


def test_search_tree_is_balanced():
    tree = prefixes.Tree()
    for i in prefixes.medians(1023):
        tree.insert([i], i)

    def height(v):
        return 0 if v < 0 else 1 + max(height(tree.lo[v]), height(tree.hi[v]))
    assert height(tree.eq[0]) == 10
