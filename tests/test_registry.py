"""Every registered query of the engine against its oracle, at the smallest scale."""

import pytest

from strataspark import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_oracle(agree, name):
    agree(name)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_names_are_unique():
    with pytest.raises(ValueError):
        registry.register("bbox_union")(lambda s, d: None)
