"""Bases of reads get the table's values where they are made: none is moved for it, and few bytes are moved for their windows."""

from pulsegrid.operators import inject, train
from pulsegrid.plans import fixtures as X
from pulsegrid.plans.queries import COMPILED, QUERIES

SF = "/root/testdata/sf0.001"


def test_bases_are_not_shuffled(spark):
    for name in ("inject_params_mapped", "inject_params_unmapped"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert plan[0].startswith("MapInArrow"), name


def test_values_and_marks_are_those_of_the_joins(spark):
    r = X.reads(spark, SF).where("doc_id < 60").select("doc_id", "read_name", "species", "seq")
    c, few = X.contigs(r), train.moments(X.reads(spark, SF).where("doc_id < 20"), COMPILED)  # most keys are not in the table
    j, marks = inject.placed(r, X.alignments(r, c), c), train.marks(c, COMPILED, ["species", "contig"])
    for circular in (True, False):
        want = inject.parameters(inject.placed_bases(j, inject.tiles(c, marks, circular), circular), few)
        got = inject.placed_bases(j, inject.tiles(c, COMPILED, circular), circular, inject.Known(few))
        assert got.dtypes == want.dtypes
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_lengths_stand_for_letters(spark, tmp_path):
    rows = [(1, "Ab C-dİK", "en", "s"), (2, None, None, "s"), (None, "abc", "de", "s"), (3, "", "de", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    r, n = X.reads(spark, str(tmp_path)), X.sizes(spark, str(tmp_path))
    same = lambda a, b: sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))
    assert same(r.selectExpr("doc_id", "read_name", "species", "cast(length(seq) as long)"), n)
    assert same(X.contigs(r).selectExpr("species", "contig", "cast(length(seq) as long)"), X.contig_sizes(n))
    assert same(X.alignments(r.drop("fi", "fp", "ri", "rp", "strain"), X.contigs(r)), X.alignments(n, X.contig_sizes(n)))
