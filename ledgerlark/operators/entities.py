"""Entity-resolution suggestions for agency names (OP-ER-*, OP-JOIN-22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import suggestion_hash
from ..functions.money import is_budget_authority
from ..functions.text import preposition_variant, prefix_expansion, us_abbreviation
from ..sources.shared import kept
from .containment import either

GENERIC_AGENCIES = 5  # an account under so many agencies says nothing


def _entries(view: DataFrame) -> DataFrame:
    """(account, agency) pairs of top-level budget authority with their fiscal years."""
    rows = view.where(is_budget_authority() & (F.col("account_name") != "") & (F.col("agency") != ""))
    return rows.select(F.trim(F.lower("account_name")).alias("account"), "agency", F.explode("fiscal_years").alias("fy")).groupBy("account", "agency").agg(F.array_sort(F.collect_set("fy")).alias("fys"))


def name_variants(agencies: DataFrame) -> DataFrame:
    """OP-ER-02: pairs of agency names (a, b), a before b, and the first pattern that fits both.

    Names are brought together by keys that variants share, so no pair of unlike names is formed.
    """
    lower = agencies.select("agency", F.lower("agency").alias("n"))
    long = F.replace(F.replace("n", F.lit("u.s. "), F.lit("united states ")), F.lit("u.s."), F.lit("united states"))
    last = F.element_at(F.split(F.trim(F.regexp_replace("n", "^[^—]*—", "")), " "), -1)
    keys = [F.when(F.contains("n", F.lit("—")), F.concat(F.lit("p:"), F.substring_index("n", "—", 1), F.lit("—"), last)), F.concat(F.lit("o:"), F.replace("n", F.lit(" of "), F.lit(" for "))), F.concat(F.lit("u:"), long)]
    keyed = lower.select("agency", "n", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("key"))
    side = lambda s: keyed.select("key", F.col("agency").alias(s), F.col("n").alias(f"n{s}"))
    pairs = side("a").join(side("b"), "key").where("a < b").select("a", "b", "na", "nb").distinct()
    pattern = F.when(prefix_expansion(F.col("na"), F.col("nb")), "prefix_expansion").when(preposition_variant(F.col("na"), F.col("nb")), "preposition_variant").when(us_abbreviation(F.col("na"), F.col("nb")), "us_abbreviation")
    return pairs.withColumn("pattern", pattern).where("pattern is not null").select("a", "b", "pattern")


def suggest(view: DataFrame) -> DataFrame:
    """OP-ER-01/SORT-07: agency pairs that may be one: hash, canonical, member, evidence, orphan_pairs_resolved.

    Evidence are accounts that both have in unlike sets of years, and accounts that both have where their names are
    variants of each other; an account found both ways counts twice. Accounts of five or more agencies don't count,
    and leave the join before pairs are formed. The entries, a row for each account and agency, are kept, so the view is read once.
    """
    entries = kept(_entries(view), "entries")
    few = entries.groupBy("account").agg(F.count("*").alias("n")).where(F.col("n").between(2, GENERIC_AGENCIES - 1)).select("account")
    rows = entries.join(few, "account", "left_semi")
    pairs = rows.select("account", F.col("agency").alias("a"), F.col("fys").alias("fa")).join(rows.select("account", F.col("agency").alias("b"), F.col("fys").alias("fb")), "account").where("a < b")
    orphans = pairs.where(F.col("fa") != F.col("fb")).select("a", "b", "account", F.lit(False).alias("by_name"))
    named = pairs.join(name_variants(entries.select("agency").distinct()), ["a", "b"]).select("a", "b", "account", F.lit(True).alias("by_name"))
    found = orphans.unionByName(named).groupBy("a", "b").agg(F.count("*").alias("orphan_pairs_resolved"), F.bool_or("by_name").alias("by_name"), F.slice(F.array_sort(F.collect_set("account")), 1, 5).alias("example_accounts"))
    longer = F.octet_length("a") >= F.octet_length("b")
    canonical, member = F.when(longer, F.col("a")).otherwise(F.col("b")), F.when(longer, F.col("b")).otherwise(F.col("a"))
    out = found.select(canonical.alias("canonical"), member.alias("member"), F.when(F.col("by_name"), "regex_pattern").otherwise("orphan_pair").alias("evidence"), "orphan_pairs_resolved", "example_accounts")
    return out.withColumn("hash", suggestion_hash(F.col("canonical"), F.array("member"))).orderBy(F.desc("orphan_pairs_resolved"), "hash")


def not_known(suggestions: DataFrame, groups: DataFrame, least_accounts: int = 1) -> DataFrame:
    """OP-FLT-16: with enough accounts, and not both in one group (canonical, member) already."""
    known = groups.select(F.lower("canonical").alias("c"), F.lower("member").alias("m"))
    return suggestions.where(F.col("orphan_pairs_resolved") >= least_accounts).join(known, (F.lower("canonical") == F.col("c")) & (F.lower("member") == F.col("m")), "left_anti")


def accepted(suggestions: DataFrame, hashes: list[str] | None = None) -> DataFrame:
    """OP-ER-04: by hash, or all."""
    return suggestions if hashes is None else suggestions.where(F.col("hash").isin(*hashes))


def merged(groups: list[tuple[str, list[str]]], new: list[tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
    """OP-ER-03: a new group joins the first that shares a name with it (whose canonical name stays), else is added."""
    out = [(c, list(m)) for c, m in groups]
    for canonical, members in new:
        names = {canonical.lower(), *(m.lower() for m in members)}
        home = next((g for g in out if names & {g[0].lower(), *(m.lower() for m in g[1])}), None)
        if home is None:
            out.append((canonical, list(members)))
            continue
        have = {home[0].lower(), *(m.lower() for m in home[1])}
        for name in (canonical, *members):
            if name.lower() not in have:
                home[1].append(name)
                have.add(name.lower())
    return out


def clusters(view: DataFrame, suggestions: DataFrame) -> DataFrame:
    """OP-JOIN-22: per suggestion the provisions of its agencies whose account and an example contain one another; two
    at least. The suggestions and the view's distinct names are kept, so neither is made again for each of their uses."""
    suggestions = kept(suggestions, "suggestions")
    agencies = suggestions.select("hash", F.explode(F.array(F.lower("canonical"), F.lower("member"))).alias("k")).distinct()
    examples = suggestions.select("hash", F.explode("example_accounts").alias("label"))
    rows = view.where("account_name <> ''").select("agency", F.lower("agency").alias("k"), F.lower("account_name").alias("name"))
    counted = kept(rows.groupBy("agency", "k", "name").agg(F.count("*").alias("n")).join(agencies, "k"), "names")
    wanted = either(counted.select("name"), examples.select("label")).join(examples, "label").select("hash", "name").distinct()
    return counted.join(wanted, ["hash", "name"]).groupBy("hash").agg(F.sum("n").alias("provisions"), F.array_sort(F.collect_set("agency")).alias("agencies")).where("provisions >= 2")
