"""Rules and SQL that odd letters and large numbers told apart, and logs that are settled in blocks."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import filing as O
from paperloom.operators import rules as R
from paperloom.plans import registry

registry.load()


def test_word_boundaries_are_ascii(spark):
    rows = {1: "aiéan an la", 2: "the the", 3: "then the", 4: "the thé", 5: "कa a", 6: "5 oé", 7: "5 ox", 8: "éKg"}
    got = R.findings(spark.createDataFrame([*rows.items()], "k int, text string"), "k", R.wording_rules(F.col("text"))).where("rule in ('R27', 'R30b', 'R31')").collect()
    assert {(r.k, r.rule) for r in got} == {(1, "R31"), (2, "R31"), (5, "R31"), (6, "R27"), (8, "R30b")}


def test_sizes_up_to_gigabytes(spark):
    sizes = [0, 1023, 1024, 1048575, 1048576, 1073741823, 1073741824, 1664299827, 1 << 42]
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT unnest(?::BIGINT[]) AS o_orderkey, 1 AS o_custkey", [sizes])
    want = dict(con.execute(registry.ORACLE["human_sizes"]).fetchall())
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", T.human_size(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == want and want[1664299827] == "1.5 GB" and want[1 << 42] == "4096.0 GB"


@pytest.mark.parametrize("seed", [1, 2])
def test_log_is_settled_in_blocks(spark, monkeypatch, seed):
    """Blocks of a few rows, which refusals run through, give what one walk through the log gives, in few rounds."""
    rng = random.Random(seed)
    moves = [(at, rng.choice([None, *range(30)]), rng.choice(["a", "b", None]), rng.choice("pqrstuvw")) for at in range(400)]
    where, held, want = {}, {}, {}
    for at, file, *slot in moves:
        slot = tuple(slot)
        want[at] = held.get(slot, file) == file
        if want[at]:
            held.pop(where.get(file), None)
            held[slot], where[file] = file, slot
    monkeypatch.setattr(O, "BLOCK", 25)
    rounds = []
    begun = O._begun
    monkeypatch.setattr(O, "_begun", lambda *a: rounds.append(1) or begun(*a))
    got = O.settle(spark.createDataFrame(moves, "at long, file int, folder string, name string"))
    assert {r.at: r.accepted for r in got.collect()} == want and 20 < sum(want.values()) < 380 and got.columns == ["at", "file", "folder", "name", "accepted"]
    assert 1 < len(rounds) <= 17
