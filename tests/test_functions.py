import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import hashes, money, text, vectors


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column.alias("x")).first().x


@pytest.mark.parametrize(("status", "tier", "want"), [("found", "exact", "strong"), ("found", "normalized", "moderate"), ("found", "spaceless", "moderate"), ("found", "no_match", "moderate"), ("found_multiple", "exact", "moderate"), ("found_multiple", "spaceless", "weak"), ("found_multiple", "no_match", "weak"), ("not_found", None, "weak"), ("found", None, "n/a"), (None, "exact", "n/a")])
def test_quality(spark, status, tier, want):
    lit = lambda v: F.lit(v).cast("string")
    assert one(spark, text.quality(lit(status), lit(tier))) == want


@pytest.mark.parametrize(("name", "want"), [("Department of VA—Compensation and Pensions", "compensation and pensions"), ("DoD–Operations", "operations"), ("A—B—C ", "c"), ("Grants-In-Aid", "grants-in-aid")])
def test_normalized_account(spark, name, want):
    assert one(spark, text.normalized_account(F.lit(name))) == want


@pytest.mark.parametrize(("agency", "want"), [("Office of Inspector General, Department of Defense", "Department of Defense"), ("Corps of Engineers—Civil, Department of Defense", "Corps of Engineers—Civil"), ("Department of Defense", "Department of Defense")])
def test_parent_department(spark, agency, want):
    assert one(spark, text.parent_department(F.lit(agency))) == want


def test_comparable(spark):
    assert one(spark, text.comparable(F.lit(" “a” \n\t‘b’—c–d‒e "))) == "\"a\" 'b'-c-d-e"
    assert one(spark, text.spaceless(F.lit("a b\nc"))) == "abc"


@pytest.mark.parametrize(("words", "want"), [("October 1, 2024", 2025), ("first quarter of fiscal year 2027", 2027), ("available until expended", None)])
def test_availability(spark, words, want):
    assert one(spark, money.availability_year(F.lit(words))) == want


@pytest.mark.parametrize(("pct", "rate", "want"), [(10.0, 0.03, "real_increase"), (-5.0, 0.03, "real_cut"), (2.0, 0.04, "inflation_erosion"), (0.0, 0.0, "unchanged"), (None, 0.03, "unchanged")])
def test_flag(spark, pct, rate, want):
    assert one(spark, money.inflation_flag(F.lit(pct).cast("double"), F.lit(rate))) == want


def test_real_delta(spark):
    assert round(one(spark, money.real_delta_pct(F.lit(10.0), F.lit(0.03))), 3) == 6.796
    assert round(one(spark, money.real_delta_pct(F.lit(5.0), F.lit(0.0))), 9) == 5


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.dot(vectors.unit(v), v)) == pytest.approx(5.0)
    assert one(spark, vectors.unit(F.array(F.lit(0.0)))) == [0.0]


def test_hashes(spark):
    import hashlib

    got = one(spark, hashes.link_hash(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2), "m"))
    assert got == hashlib.sha256("a:1→b:2:m".encode()).hexdigest()[:8]
    x, y = (one(spark, hashes.suggestion_hash(F.lit("C"), F.array(*map(F.lit, m)))) for m in (["b", "A"], ["a", "B"]))
    assert x == y


def test_names(spark):
    yes = lambda c: one(spark, c) is True
    assert yes(text.prefix_expansion(F.lit("d—army"), F.lit("d—department of the army")))
    assert yes(text.preposition_variant(F.lit("office of x"), F.lit("office for x")))
    assert yes(text.us_abbreviation(F.lit("u.s. x"), F.lit("united states x")))
    assert not yes(text.us_abbreviation(F.lit("u.s. x"), F.lit("u.s. x")))
    assert one(spark, text.fas_code(F.lit("70-2024/2025-0400-000"))) == "070-0400"
    assert one(spark, text.bill_label(F.lit("H.R. 1"), F.lit(118))) == "H.R. 1 (118th)"
