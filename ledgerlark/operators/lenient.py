"""Lenient JSON: provisions as models write them, with counts of what had to be bent (OP-JSON-*).

An answer is one variant; each provision of it is a map of variants by field, and each field is read as what its variant of
provision declares. What doesn't fit becomes a default and is counted; answers and elements that can't be read come out as
rows with their error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import TYPES

# The fields of each type of provision, by how they are read.
_TOLD = {  # texts that are expected: missing ones are counted, other values are written as JSON
    "appropriation": ("account_name", "detail_level"),
    "rescission": ("account_name",),
    "transfer_authority": ("from_scope", "to_scope"),
    "limitation": ("description",),
    "directed_spending": ("detail_level",),
    "cr_substitution": ("reference_act", "reference_section"),
    "mandatory_spending_extension": ("program_name", "statutory_reference"),
    "directive": ("description",),
    "rider": ("description",),
    "continuing_resolution_baseline": ("rate",),
    "other": ("description",),
}
_TEXT = {  # texts that may be missing
    "appropriation": ("agency", "program", "parent_account"),
    "rescission": ("agency", "reference_law", "fiscal_years"),
    "limitation": ("account_name", "parent_account"),
    "directed_spending": ("account_name", "parent_account"),
    "cr_substitution": ("account_name",),
    "mandatory_spending_extension": ("period", "extends_through"),
    "rider": ("policy_area",),
    "continuing_resolution_baseline": ("duration",),
}
_TEXTS = {"transfer_authority": ("conditions",), "directive": ("deadlines",), "continuing_resolution_baseline": ("reference_laws",), "other": ("references",)}
_AMOUNTS = {  # field, and the meaning of the zero that stands for a missing one (None: may be missing)
    "appropriation": (("amount", "indefinite"),),
    "rescission": (("amount", "rescission"),),
    "limitation": (("amount", None),),
    "directed_spending": (("amount", "indefinite"),),
    "cr_substitution": (("new_amount", "indefinite"), ("old_amount", "reference_amount")),
    "mandatory_spending_extension": (("amount", None),),
}
_WARNED = ("appropriation", "rescission")
_COMMON = ("provision_type", "section", "division", "title", "confidence", "raw_text", "notes", "cross_references", "description", "amount", "references")
_AMOUNT = "struct<kind:string,dollars:bigint,semantics:string,text_as_written:string>"


def fenced(text: Column) -> Column:
    """OP-JSON-07/08: the JSON inside a fenced or chatty answer: the fence's body, else from the first to the last bracket."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    return F.trim(F.when(fence != "", fence).otherwise(braces))


# Readers of a value (a variant; null where the field is missing), OP-JSON-06


def _shape(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _object_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "struct<__:binary>").isNotNull()


def _array_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<binary>").isNotNull()


def _object(v: Column) -> Column:
    """Whether it is an object; a cast to a field that isn't looked at copies nothing of what is inside."""
    return _object_at(v, "$")


def _array(v: Column) -> Column:
    return _array_at(v, "$")


def _once(v: Column, read) -> Column:  # noqa: ANN001
    """``read`` of a value that is computed once, outside the generated code, which has a limit of size."""
    return F.transform(F.array(v), read)[0]


def _member(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _string_at(v: Column, path: str) -> Column:
    """The text in that place; null for anything else, as of all JSON texts alone are read as bytes."""
    return F.try_variant_get(v, path, "binary").cast("string")


def string(v: Column) -> Column:
    """A text; null for anything else."""
    return _string_at(v, "$")


def whole(v: Column) -> Column:
    """A whole number that isn't negative, from a number or its text."""
    digits = F.when(string(v).rlike(r"^\+?[0-9]+$"), string(v)).try_cast("bigint")
    number = F.when(_shape(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))
    return F.when(F.coalesce(number, digits).between(0, 2**32 - 1), F.coalesce(number, digits))


def share(v: Column) -> Column:
    """A number or a text of one, else 0."""
    return F.coalesce(F.when(_shape(v) == "STRING", string(v).try_cast("float")).otherwise(F.try_variant_get(v, "$", "float")), F.lit(0.0).cast("float"))


def members(v: Column, keep) -> Column:  # noqa: ANN001
    """An array's elements that pass; what is no array has none."""
    return F.filter(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")), keep)


def strings(v: Column) -> Column:
    texts = F.coalesce(F.try_variant_get(v, "$", "array<binary>"), F.array().cast("array<binary>"))
    return F.transform(F.array_compact(texts), lambda x: x.cast("string"))


def _dollars(v: Column) -> Column:
    """The place of an amount's number: as models write it, else as it is stored."""
    return F.coalesce(_member(v, "dollars"), _member(v, "value.dollars"))


def amount(v: Column) -> Column:
    """OP-JSON-03: kind, dollars, semantics and text; null if there is no amount. Such sums have no dollars; a text loses its
    marks, and what is no whole number then is 0."""
    return paid(v)["a"]


def bent(v: Column) -> Column:
    """Whether an amount's number was a text."""
    return F.coalesce(paid(v)["bent"], F.lit(False))


def _kind(v: Column) -> Column:
    return F.coalesce(_string_at(v, "$.kind"), F.when(_member(v, "kind").isNull(), _string_at(v, "$.value.kind")))


def paid(v: Column) -> Column:
    """``amount`` as ``a``, and ``bent``; what has no number is neither. Kind, number, its text and its shape are read once."""
    told = F.struct(_kind(v).alias("kind"), _dollars(v).alias("number"))
    shaped = _once(told, lambda t: F.struct(t["kind"].alias("kind"), t["number"].alias("number"), string(t["number"]).alias("text"), _shape(t["number"]).alias("shape")))

    def read(t: Column) -> Column:
        bare = F.regexp_replace(t["text"], "[,$]", "")
        parsed = F.when(t["shape"] == "STRING", F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare.try_cast("bigint"))).when(t["shape"] == "BIGINT", F.try_variant_get(t["number"], "$", "bigint"))
        such, kind = F.coalesce(t["kind"] == "such_sums", F.lit(False)), F.coalesce(t["kind"], F.lit(""))
        there = such | (t["shape"].rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)") & (kind != "none"))  # only objects have either
        a = F.struct(F.when(such, "such_sums").otherwise("specific").alias("kind"), F.when(~such, F.coalesce(parsed, F.lit(0))).alias("dollars"), F.coalesce(_string_at(v, "$.semantics"), F.lit("other")).alias("semantics"), F.coalesce(_string_at(v, "$.text_as_written"), F.lit("")).alias("text_as_written"))
        return F.struct(F.when(there, a).alias("a"), ((t["shape"] == "STRING") & ~kind.isin("such_sums", "none")).alias("bent"))

    return F.when(v.isNotNull(), _once(shaped, read))


def availability(v: Column) -> Column:
    """OP-JSON-04: kind (no_year, one_year, multi_year, other), year, and what was written if other."""
    one, through = _member(v, "fiscal_year"), _member(v, "through")
    dated = lambda x: F.when((_shape(x) == "BIGINT") & (F.try_variant_get(x, "$", "bigint") >= 0), F.try_variant_get(x, "$", "bigint"))
    plain = F.coalesce(string(v), F.to_json(v))
    free = (string(v) == "no_year") | (_object(v) & _member(v, "no_year").isNotNull())
    kind = F.when(F.coalesce(free, F.lit(False)), "no_year").when(dated(one).isNotNull(), "one_year").when(dated(through).isNotNull(), "multi_year").otherwise("other")
    year = F.when(kind == "one_year", dated(one)).when(kind == "multi_year", dated(through))
    return F.when(_shape(v) != "VOID", F.struct(kind.alias("kind"), year.alias("year"), F.when(kind == "other", plain).alias("text")))


def transfer_limit(v: Column) -> Column:
    """OP-JSON-05: a percentage, a fixed amount (named or the object itself), or what was written."""
    percent = F.when(_shape(_member(v, "percentage")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$.percentage", "double"))
    named = _member(v, "fixed_amount")
    fixed = F.when(_object(v) & percent.isNull(), F.when(named.isNotNull(), amount(named)).otherwise(amount(v)))
    text = F.when(_object(v), F.to_json(v)).otherwise(F.coalesce(string(v), F.lit("unknown")))
    kind = F.when(percent.isNotNull(), "percentage").when(fixed.isNotNull(), "fixed_amount").otherwise("other")
    return F.struct(kind.alias("kind"), percent.alias("percentage"), fixed.alias("amount"), F.when(kind == "other", text).alias("text"))


def _empty(v: Column) -> Column:
    return F.coalesce(string(v), F.lit(""))


def _text_at(v: Column, name: str) -> Column:
    """A field's text, from its place; empty for anything else."""
    return F.coalesce(_string_at(v, f"$.{name}"), F.lit("")).alias(name)


def earmark(v: Column) -> Column:
    return F.struct(_text_at(v, "recipient"), _text_at(v, "location"), _string_at(v, "$.requesting_member").alias("requesting_member"))


def proviso(v: Column) -> Column:
    return F.struct(_text_at(v, "proviso_type"), _text_at(v, "description"), amount(_member(v, "amount")).alias("amount"), strings(_member(v, "references")).alias("references"), _text_at(v, "raw_text"))


def reference(v: Column) -> Column:
    return F.struct(_text_at(v, "ref_type"), _text_at(v, "target"), _string_at(v, "$.description").alias("description"))


# Whole answers


def answers(rows: DataFrame, key: str, text: str, chunks: bool = False) -> DataFrame:
    """OP-JSON-01: key, the answer as a variant ``v`` and what keeps it from being read, by name (``error``).

    An answer has a bill, a summary and provisions; with ``chunks`` provisions alone do, or a bare list of them.
    """
    read = rows.select(F.col(key), F.try_parse_json(fenced(F.col(text))).alias("v"))
    v = F.col("v")
    part = lambda n: F.try_variant_get(v, f"$.{n}", "variant")
    error = F.when(v.isNull(), "Answer is not JSON")
    if chunks:
        error = error.when(~_array_at(v, "$.provisions") & ~_array(v), "Missing 'provisions' array")
    else:
        error = error.when(~_object(v), "Expected root object")
        for name in ("bill", "summary"):
            error = error.when(part(name).isNull(), f"Missing '{name}'").when(~_object_at(v, f"$.{name}"), f"{name} not an object")
        error = error.when(~_array_at(v, "$.provisions"), "Missing 'provisions' array")
    return read.select(key, "v", error.alias("error"))


def bill(v: Column) -> Column:
    """An answer's bill."""
    at = lambda n: F.try_variant_get(v, f"$.bill.{n}", "variant")
    years = F.filter(F.transform(members(at("fiscal_years"), lambda x: _shape(x) == "BIGINT"), lambda x: F.try_variant_get(x, "$", "bigint")), lambda y: y.isNotNull())
    return F.struct(_empty(at("identifier")).alias("identifier"), _empty(at("classification")).alias("classification"), string(at("short_title")).alias("short_title"), years.alias("fiscal_years"), strings(at("divisions")).alias("divisions"), string(at("public_law")).alias("public_law"))


def summary(v: Column) -> Column:
    """An answer's own summary; counts and sums that are no whole numbers are 0."""
    at = lambda n: F.try_variant_get(v, f"$.summary.{n}", "variant")
    number = lambda x: F.coalesce(F.when(_shape(x) == "BIGINT", F.try_variant_get(x, "$", "bigint")), F.lit(0))
    counts = lambda n: F.transform_values(F.coalesce(F.try_variant_get(at(n), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, x: F.greatest(number(x), F.lit(0)))
    return F.struct(F.greatest(number(at("total_provisions")), F.lit(0)).alias("total_provisions"), counts("by_division").alias("by_division"), counts("by_type").alias("by_type"), number(at("total_budget_authority")).alias("total_budget_authority"), number(at("total_rescissions")).alias("total_rescissions"), strings(at("sections_with_no_provisions")).alias("sections_with_no_provisions"), strings(at("flagged_issues")).alias("flagged_issues"))


def _of(fields: dict, name: str) -> list[str]:
    return [kind for kind, names in fields.items() if name in [n if isinstance(n, str) else n[0] for n in names]]


def _total(counts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(c.cast("int"), F.lit(0)) for c in counts))


def provisions(rows: DataFrame, key: str, text: str, chunks: bool = False, heads=None) -> DataFrame:  # noqa: ANN001
    """OP-JSON-01 to 06: one row per provision of each answer, ``ord`` from 0, with the fields of its type; others are null.
    ``heads`` of an answer, from its variant, come as a column of its first row, so that the answer isn't parsed again for them.

    Unknown types are *other* and keep their name and leftover fields (``metadata``, values as JSON). An element that is no
    object, and an answer that can't be read (``ord`` null), is ``failed`` with its ``error``.
    """
    read = answers(rows, key, text, chunks)
    listed = F.coalesce(F.try_variant_get("v", "$.provisions", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    also = ["heads"] if heads else []
    read = read.select(key, "error", F.when(F.col("error").isNull(), listed).alias("listed"), *(heads(F.col("v")).alias(c) for c in also))  # apart, so before rows are made
    each = read.select(key, "error", F.posexplode_outer("listed").alias("ord", "p"), *also).where("error is not null or ord is not null")
    each = each.withColumns({c: F.when(F.coalesce("ord", F.lit(0)) == 0, F.col(c)) for c in also}) if also else each
    # what is told by texts is read at once; other fields where they are needed, each from its place
    names = lambda table: dict.fromkeys(n if isinstance(n, str) else n[0] for v in table.values() for n in v)
    known = dict.fromkeys(("provision_type", "section", "raw_text", "division", "title", "recipient", "location", "requesting_member", "confidence")) | names(_TOLD) | names(_TEXT)
    each = each.select(key, "error", "ord", "p", *also, F.try_variant_get("p", "$", f"struct<{','.join(f'{n}:binary' for n in known)}>").alias("t"))
    value = lambda n: F.try_variant_get("p", f"$.{n}", "variant")
    text_of = lambda n: F.col("t")[n].cast("string")
    void = lambda n: F.col("t")[n].isNull() & (value(n).isNull() | F.is_variant_null(value(n)))
    failed, named = F.col("t").isNull(), F.coalesce(text_of("provision_type"), F.lit(""))
    known = F.when(named.isin(*(t for t in TYPES if t != "other")), named).otherwise("other")
    amounts = {n: [*_of(_AMOUNTS, n), *(["other"] if n == "amount" else [])] for n in ("amount", "new_amount", "old_amount")}
    money = F.transform(F.array(*(F.when(known.isin(*kinds), value(n)) for n, kinds in amounts.items())), paid)
    each = each.select(key, "error", "ord", "p", *also, "t", failed.alias("failed"), named.alias("named"), F.when(~failed, known).alias("kind"), F.when(~failed, money).alias("money"))
    sums = dict(zip(("amount", "new_amount", "old_amount"), (F.col("money")[i] for i in range(3)), strict=True))
    of = lambda kinds, c: F.when(F.col("kind").isin(*kinds), c)
    good = ~F.col("failed")

    out = {n: F.when(good, F.coalesce(text_of(n), F.lit(""))) for n in ("section", "raw_text")} | {n: text_of(n) for n in ("division", "title")}
    out["confidence"] = F.when(good, _once(value("confidence"), share))
    out |= {"notes": F.when(good, strings(value("notes"))), "cross_references": F.when(good, F.transform(members(value("cross_references"), _object), reference))}
    for n in names(_TOLD) | names(_TEXT):
        expected = F.coalesce(text_of(n), F.when(void(n), "").otherwise(F.to_json(value(n))))
        out[n] = F.coalesce(*(of(kinds, c) for kinds, c in ((_of(_TOLD, n), expected), (_of(_TEXT, n), text_of(n))) if kinds))
    out |= {n: of(_of(_TEXTS, n), strings(value(n))) for n in names(_TEXTS)}
    zero = lambda meaning: F.struct(F.lit("specific").alias("kind"), F.lit(0).cast("bigint").alias("dollars"), F.lit(meaning).alias("semantics"), F.lit("").alias("text_as_written"))
    for n in names(_AMOUNTS):
        meant = {k: m for k, v in _AMOUNTS.items() for f, m in v if f == n}
        default = reduce(lambda c, k: c.when(F.col("kind") == k, zero(meant[k])), [k for k in meant if meant[k]], F.when(F.lit(False), F.lit(None).cast(_AMOUNT)))
        out[n] = of(meant, F.coalesce(sums[n]["a"], default))
    out["amounts"] = of(["other"], F.array_compact(F.array(sums["amount"]["a"])))
    out["fiscal_year"] = of(["appropriation"], _once(value("fiscal_year"), whole))
    out["reference_year"] = of(["continuing_resolution_baseline"], F.coalesce(_once(value("reference_year"), whole), F.lit(0)))
    out["availability"] = of(["appropriation"], _once(value("availability"), availability))
    out["provisos"] = of(["appropriation"], F.transform(members(value("provisos"), _object), proviso))
    out["earmarks"] = of(["appropriation"], F.transform(members(value("earmarks"), _object), earmark))
    own = {n: text_of(n) for n in ("recipient", "location", "requesting_member")}
    out["earmark"] = of(["directed_spending"], F.struct(*((c if n == "requesting_member" else F.coalesce(c, F.lit(""))).alias(n) for n, c in own.items())))
    out["limit"] = of(["transfer_authority"], _once(value("limit"), transfer_limit))
    out["metadata"] = of(["other"], F.transform_values(F.map_filter(F.try_variant_get("p", "$", "map<string,variant>"), lambda k, _: ~k.isin(*_COMMON)), lambda _, x: F.to_json(x)))

    missing = [of(_of(_TOLD, n), void(n)) for n in names(_TOLD)]
    coerced = [of(_of(_TOLD, n), F.col("t")[n].isNull() & ~void(n)) for n in names(_TOLD)]
    coerced += [of(amounts[n], sums[n]["bent"]) for n in names(_AMOUNTS)] + [good & F.col("t")["confidence"].isNotNull()]
    lost = of(_WARNED, sums["amount"]["a"].isNull())
    warning = F.when(F.col("error").isNull() & F.col("failed"), F.concat(F.lit("Provision "), F.col("ord").cast("string"), F.lit(": provision not an object"))).when(lost, F.concat(F.lit("SEC "), F.coalesce(text_of("section"), F.lit("")), F.lit(": missing amount on "), F.col("kind")))
    error = F.coalesce("error", F.when(F.col("failed"), F.lit("provision not an object")))
    return each.select(key, "ord", "failed", error.alias("error"), F.col("kind").alias("provision_type"), of(["other"], F.col("named")).alias("llm_classification"), *(c.alias(n) for n, c in out.items()), _total(missing).alias("null_to_default"), _total(coerced).alias("type_coercions"), warning.alias("warning"), *also)


def report(parsed: DataFrame, key: str) -> DataFrame:
    """OP-AGG-18: counts per answer, with its error if it can't be read, and its ``heads`` if they were read; sums over answers
    are the merged report."""
    inside = F.col("ord").isNotNull()
    also = [F.first("heads", ignorenulls=True).alias("heads")] if "heads" in parsed.columns else []
    return parsed.groupBy(key).agg(
        F.max(F.when(~inside, F.col("error"))).alias("error"),
        F.count_if(~F.col("failed")).alias("provisions_parsed"),
        F.count_if(inside & F.col("failed")).alias("provisions_failed"),
        F.sum("null_to_default").alias("null_to_default"),
        F.sum("type_coercions").alias("type_coercions"),
        F.count_if(F.col("llm_classification").isNotNull()).alias("unknown_provision_types"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("ord", "warning")))), lambda w: w["warning"]).alias("warnings"),
        *also,
    )


def upgraded_amount(a: Column) -> Column:
    """OP-JSON-09/UPG-01: semantics *missing* is *indefinite*; a specific zero without text is *such_sums*."""
    none = (a["value"]["kind"] == "specific") & (a["value"]["dollars"] == 0) & (F.coalesce(a["text_as_written"], F.lit("")) == "")
    value = F.when(none, F.struct(F.lit("such_sums").alias("kind"), F.lit(None).cast("bigint").alias("dollars"))).otherwise(F.struct(a["value"]["kind"].alias("kind"), a["value"]["dollars"].alias("dollars")))
    return F.when(a.isNotNull(), F.struct(value.alias("value"), F.when(a["semantics"] == "missing", "indefinite").otherwise(a["semantics"]).alias("semantics"), a["text_as_written"].alias("text_as_written")))


def upgraded(extractions: DataFrame) -> DataFrame:
    """OP-UPG-01: unversioned extractions at schema 1.0 with migrated amounts; others stay."""
    new = F.transform("provisions", lambda p: p.withField("amount", upgraded_amount(p["amount"])))
    old = F.col("schema_version").isNull()
    return extractions.withColumn("provisions", F.when(old, new).otherwise(F.col("provisions"))).withColumn("schema_version", F.coalesce("schema_version", F.lit("1.0")))
