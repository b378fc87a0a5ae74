"""What several groupings read is computed once: their plans begin at the written table."""

from varspan.jobs import queries


def test_allele_lines_are_computed_once(spark):
    plan = queries.q_allele_labels(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # neither the lines' pixels nor the join that makes the sites
    assert "Generate" not in plan and "lineitem" not in plan


def test_frequencies_read_written_segments(spark):
    plan = queries.q_pos_freq(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # runs at ends of tiles meet on either side; no span is exchanged again for the join
    assert "lineitem" not in plan and plan.count("Exchange hashpartitioning") <= 4
