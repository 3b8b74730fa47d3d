"""2000 replicates, and paired runs on the same draws."""

from loomspark.operators import registry

from parity import SF


def test_replicates_and_pairs(spark):
    boot = registry.QUERIES["W20_group_bootstrap"](spark, SF).first()
    whole = [r.delta for r in registry.QUERIES["J13_paired_draw"](spark, SF).where("stratum = '*'").collect()]
    assert boot.replicates == len(whole) == 2000
    assert len(set(whole)) > 100  # draws differ
    assert abs(sum(whole) / 2000 - boot.mean_delta) < 1e-5
