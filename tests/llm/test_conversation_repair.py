"""Conversation repair: edits against an exhaustive search, the query against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from review_insights.llm import conversation_repair as cr
from review_insights.llm import queries

SOUND = re.compile("(s?(ua)+)?")


def fits(previous, initial):
    return initial == "s" and previous == "" or initial == "u" and previous in ("", "s", "a") or initial == "a" and previous == "u"


def cheapest(rows, spread=None):
    """Least ``(cost, audit, repaired rows)`` over whole edit strings, extending every one that is kept: with
    ``spread`` all that cost at most so much more than the cheapest, else the least of each last role."""
    def inserted(found):
        out, last = list(found), list(found)
        for _ in range(2):
            last = [(c + 5, a + "I", o + ((r, ""),), r[0]) for c, a, o, p in last for r in ("user", "assistant") if fits(p, r[0])]
            out += last
        return out

    found = [(0, "", (), "")]
    for role, text, fault in rows:
        after = []
        for c, a, o, p in inserted(found):
            after.append((c + 2, a + "D", o, p))
            if fault not in (cr.BLANK, cr.DUPLICATE):
                more = 5 if fault == cr.TRUNCATED else 0
                if fits(p, role[:1]):
                    after.append((c + more, a + "K", o + ((role, text),), role[:1]))
                after += [(c + 1 + more, a + "R", o + ((r, text),), r[0]) for r in ("user", "assistant") if fits(p, r[0])]
        if spread is None:
            best = {}
            for x in sorted(after):
                best.setdefault(x[3], x)
            found = list(best.values())
        else:
            least = min(x[0] for x in after)
            found = [x for x in set(after) if x[0] <= least + spread]
    ends = [(c, a, o) for c, a, o, p in inserted(found) if p in ("", "a")]
    assert all(SOUND.fullmatch("".join(r[:1] for r, _ in o)) for _, _, o in ends)
    return min(ends)


def streamed(rows):
    out = []
    repair = cr.Repair(lambda edit, times, turn, role, text: out.append((edit, times, role, text)))
    for k, (role, text, fault) in enumerate(rows):
        repair.row(k, role, text, fault)
    cost = repair.end()
    return cost, "".join(e * n for e, n, _, _ in out), tuple((r, t) for e, _, r, t in out if e != "D")


def conversation(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "x", ""]
    return [(rng.choice(roles), f"t{k}", rng.choice([0, 0, 0, 1, 2, 3, 3])) for k in range(n)]


def test_edits_equal_an_exhaustive_search():
    rng = random.Random(1)
    for _ in range(4000):
        rows = conversation(rng, rng.randint(0, 5))
        assert streamed(rows) == cheapest(rows, spread=14), rows


def test_edits_of_long_conversations():
    rng = random.Random(2)
    for _ in range(60):
        rows = conversation(rng, rng.randint(20, 200))
        assert streamed(rows) == cheapest(rows), rows


@pytest.mark.parametrize("row, most", [(lambda k: (("user", "assistant")[k % 2], 0), 4), (lambda k: ("user", 1), 4),
                                       (lambda k: ("user", 3), 8)])
def test_resolved_edits_leave_memory(row, most):
    emitted = []
    repair = cr.Repair(lambda edit, times, *_: emitted.append(times))
    for k in range(20_000):
        role, fault = row(k)
        repair.row(k, role, "text", fault)
        assert repair.unresolved <= most
    assert sum(emitted) > 19_000
    repair.end()


def test_ends_that_stay_open_are_compared_whole():
    """Roles that fit nowhere: all rerolled if even, else the first one deleted."""
    for n in (400, 401):
        cost, audit, _ = streamed([("x", f"t{k}", 0) for k in range(n)])
        assert (cost, audit) == ((n, "R" * n) if n % 2 == 0 else (n + 1, "D" + "R" * (n - 1)))


SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """The query's rows, from ``(conv_id, turn, role, text)``."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        group = groups[conv]
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        group += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in group:
            ink = text.strip(SPACE)
            fault = cr.BLANK if not ink else cr.DUPLICATE if (role, text) in seen else cr.TRUNCATED if ink[-1] not in ".!?" else cr.SOUND
            seen.add((role, text))
            faulty.append((role, text, fault))
        cost, audit, repaired = cheapest(faulty)
        turns = {t for t, _, _ in group if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
        faults = [sum(f == k for _, _, f in faulty) for k in (cr.BLANK, cr.DUPLICATE, cr.TRUNCATED)]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, digest))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_query(spark, sf_small):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf_small}/conversations.parquet'").fetchall()
    found = queries.QUERIES["op12_conversation_repair"](spark, sf_small).collect()
    assert order(map(tuple, found)) == order(plain(rows))


def test_edges(spark):
    rng = random.Random(3)
    text = lambda: rng.choice(["A sentence.", "no end", "", None, " \t ", "Why?", "So!\n", "é.", "long. " * 20_000])
    rows = [(conv, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"]), text())
            for conv in [None, *range(40)] for _ in range(rng.randint(1, 9))]
    rows += [(50 + k, 7, "user", "Hello.") for k in range(60)]  # some of them lose their only row
    rows += [(200, k, ("user", "assistant")[k % 2], "Same.") for k in range(3000)]  # a long conversation of copies
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, present int").repartition(4)
    found = order(map(tuple, cr.repair_report(cr.damaged(df)).collect()))
    assert found == order(plain(rows))
    assert any(r[-2] == "" and r[-1] == hashlib.sha256(b"").hexdigest() for r in found)
    assert cr.repair_report(cr.damaged(df.limit(0))).count() == cr.repair_conversations(df.limit(0)).count() == 0


def test_repaired_rows(spark):
    df = spark.createDataFrame([("b", 2, "user", "One."), ("b", 1, "system", "S."), ("b", 5, "tool", "Two."), ("b", 4, "user", " "),
                                ("a", 1, "assistant", "Alone.")], "c string, t int, role string, text string")
    found = cr.repair_conversations(df, conv_col="c", turn_col="t").orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in found if r["conv_id"] == "b"] == [
        ("b", 0, "K", 1, "system", "S."), ("b", 1, "K", 2, "user", "One."), ("b", 2, "R", 5, "assistant", "Two.")]
    assert [tuple(r)[1:] for r in found if r["conv_id"] == "a"] == []  # deleting it is cheaper than a turn before it


def test_one_shuffle_by_conversation(spark, sf_small):
    plan = queries.QUERIES["op12_conversation_repair"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_long_texts_stream(spark):
    df = spark.range(200).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                 F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 200_000), F.lit(".")).alias("text"))
    rows = [(1, k, ("user", "assistant")[k % 2], str(k) + "x" * 200_000 + ".") for k in range(200)]
    assert order(map(tuple, cr.repair_report(cr.damaged(df)).collect())) == order(plain(rows))
