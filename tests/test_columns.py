import math

import pytest
from pyspark.sql import functions as F

from residuum.functions import columns as C
from residuum.functions import constants as K


@pytest.fixture(scope="module")
def one(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first()["x"]


def test_fixed_values():
    assert (len(K.CODING_CLASSES), len(K.NONCODING_CLASSES), len(K.SOLVENT_LIGANDS), len(K.RESIDUE_LETTERS)) == (34, 8, 46, 41)
    assert len(K.CODONS) == 64 and K.CODONS["atg"] == "M" and sum(a == "*" for a in K.CODONS.values()) == 3
    assert len(set(K.channels())) == 96


def test_channels_follow_their_order(spark):
    rows = [(c[:3], c[-1], i) for i, c in enumerate(K.channels())]
    turned = [("".join({"a": "t", "c": "g", "g": "c", "t": "a"}[x] for x in reversed(a)), {"a": "t", "c": "g", "g": "c", "t": "a"}[n], i) for a, n, i in rows]
    frame = spark.createDataFrame(rows + turned + [("anc", "a", None), ("aaa", "a", None)], "abc string, n string, i int")
    assert frame.filter(~C.channel_index(F.col("abc"), F.col("n")).eqNullSafe(F.col("i"))).count() == 0


@pytest.mark.parametrize("count,mean,sd,expected", [
    (1.0, 0.0, 0.0, 1.0), (2.0, math.log10(2), 0.0, 0.0), (5.0, 6.0, 1.0, 1.0), (1000.0, 1.0, 1.0, 1 / math.log10(999)), (3.0, 1.0, 2.0, 1.0),
])
def test_zlog_edges(one, count, mean, sd, expected):
    assert one(C.zlog(F.lit(count), F.lit(mean), F.lit(sd))) == pytest.approx(expected)


def test_small_helpers(one):
    lit = F.lit
    assert one(C.hill(lit(2.0))) == 0.5
    assert one(C.reverse_complement(lit("acg"))) == "cgt"
    assert one(C.chromosome_name(lit("23"))) == "chrX" and one(C.chromosome_name(lit("MT"))) == "chrM"
    assert one(C.chromosome_number(lit("chrY"))) == 24 and one(C.chromosome_number(lit("7"))) == 7
    assert one(C.identity(lit("a:1 pdb_identity:87.5"))) == 87.5 and one(C.identity(lit("-"))) == 100.0
    assert [tuple(x) for x in one(C.residue_map(lit("1:5 2:-3")))] == [(1, 5), (2, -3)]
    assert [one(C.mutation_class(lit("A"), lit(x))) for x in "*AV"] == ["N", "S", "M"]
    assert one(C.jaccard(*map(lit, (0, 10, 5, 15)))) == pytest.approx(5 / 15)
    assert one(C.jaccard(*map(lit, (3, 3, 3, 3)))) == 0.0
    assert one(C.overlap_of_shorter(*map(lit, (0, 10, 8, 9)))) == 1.0
    assert [one(C.partner_kind(lit(x))) for x in ("A_0_DNA", "A,B_0_DNA/RNA", "A_0_DNA/RNA", "A_0_RNA", "A_1_ATP")] == list("dDdRL")
    assert one(C.p_floor(lit(0), lit(100))) == 0.01
    assert 0 < one(C.uniform(lit("a"), lit(1))) < 1
    assert one(C.kernel(lit(36.0), 6.0)) == pytest.approx(math.exp(-0.5))
