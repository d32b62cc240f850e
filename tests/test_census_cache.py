import pytest

from tributary.sources import census_cache as cc


def test_cache_is_fetched_once_and_again_when_stale(spark, tmp_path):
    asked = []

    def fetch(codes):
        asked.append(codes)
        return [{"GEOID": "037063000101", **{c: 1.5 for c in codes}}, {"GEOID": "037063000102", **{c: None for c in codes}}]

    go = lambda variables, vintage=2024, **k: cc.refresh(str(tmp_path), "acs5", vintage, variables, {"B1_001E"}, fetch, **k)
    assert go(["B1_001E", "B1_001M"]) and not go(["B1_001M", "B1_001E"])
    assert go(["B1_001E"]) and go(["B1_001E"], vintage=2025) and go(["B1_001E"], vintage=2025, force=True)
    assert asked == [["B1_001E", "B1_001M"], ["B1_001E"], ["B1_001E"], ["B1_001E"]]
    rows = {r.GEOID: r.B1_001E for r in cc.read_cached(spark, str(tmp_path), "acs5").collect()}
    assert rows == {"037063000101": 1.5, "037063000102": None}
    (tmp_path / "data/census/acs5_2025.csv").unlink()
    assert go(["B1_001E"], vintage=2025)
    with pytest.raises(FileNotFoundError, match="decennial"):
        cc.read_cached(spark, str(tmp_path), "decennial")


def test_missing_codes_need_a_published_replacement():
    assert cc.resolve_variables(["A_1E", "A_1M"], {"A_1E"}) == (["A_1E", "A_1M"], {})
    assert cc.resolve_variables(["OLD"], {"NEW"}, lambda missing, known: {"OLD": "NEW", "X": "NEW"}) == (["NEW"], {"OLD": "NEW"})
    for resolver in (None, lambda missing, known: None, lambda missing, known: {"OLD": "GONE"}):
        with pytest.raises(ValueError, match="OLD"):
            cc.resolve_variables(["OLD"], {"NEW"}, resolver)
