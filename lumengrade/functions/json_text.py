"""Recovery and strict reading of model output that should be one JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import strip

# Keys that a grade object must have.
REQUIRED = ("nota", "comentario", "criterios_atendidos", "criterios_ausentes", "revisao_necessaria")
OTHERS = ("needs_human_review", "missing_concepts", "detected_concepts")  # further keys whose kind counts


def strict_objects(text: Column) -> Column:
    """What `text` holds between brackets: one map of key to value text if it is exactly one JSON object (text after it, quotes of the wrong
    kind and trailing commas are refused; the last of equal keys wins)."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false"})


def strict_object(text: Column) -> Column:
    """Map of key to value text if `text` is exactly one JSON object, else null."""
    single = F.filter(F.array(strict_objects(text)), lambda a: F.size(a) == 1)
    return F.get(F.get(single, F.lit(0)), F.lit(0))


def with_recovery(df: DataFrame, raw: str) -> DataFrame:
    """df with the first repair of `raw` that is one object, as text (_txt) and as map of value texts (_obj); null where all fail.

    The repairs, in order: without code fence and from the first { to the last }; straight quotes; no trailing commas;
    decimal points. Each step is a column of its own, so that none is worked out twice.
    """
    bare = strip(F.regexp_replace(F.regexp_replace(strip(F.col(raw)), r"^```(json|JSON)?\s*", ""), r"\s*```$", ""))
    df = df.withColumn("_bare", bare)
    df = df.withColumns({"_first": F.instr("_bare", "{"), "_last": F.length("_bare") - F.instr(F.reverse("_bare"), "}") + 1})
    inside = (F.col("_first") > 0) & (F.col("_last") > F.col("_first")) & (F.col("_last") <= F.length("_bare"))
    df = df.withColumn("_1", F.when(inside, F.substr("_bare", "_first", F.col("_last") - F.col("_first") + 1)).otherwise(F.col("_bare")))
    df = df.withColumn("_2", F.translate("_1", "“”‘’", "\"\"''"))
    df = df.withColumn("_3", F.regexp_replace("_2", r",\s*([}\]])", "$1"))
    df = df.withColumn("_4", F.regexp_replace("_3", r"(\d),(\d)", "$1.$2"))
    # A text is parsed only where those before it failed and it differs from them: mostly the first one is the only one.
    done, txt, obj = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for k in range(1, 5):
        new = ~done if k == 1 else ~done & (F.col(f"_{k}") != F.col(f"_{k - 1}"))
        df = df.withColumn(f"_list{k}", F.when(new, strict_objects(F.col(f"_{k}"))))
        df = df.withColumn(f"_ok{k}", F.coalesce(done | ((F.size(f"_list{k}") == 1) & F.get(f"_list{k}", F.lit(0)).isNotNull()), F.lit(False)))
        found = F.col(f"_ok{k}") & ~done
        txt, obj = F.when(found, F.col(f"_{k}")).otherwise(txt), F.when(found, F.get(f"_list{k}", F.lit(0))).otherwise(obj)
        done = F.col(f"_ok{k}")
    # A caller's filter on the outcome must not be moved below these steps, where each would stand in it many times over: it isn't
    # moved past a row number, so the outcome leans on one.
    stay = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)
    return df.withColumns({"_txt": stay(txt), "_obj": stay(obj)}).drop("_bare", "_first", "_last", *[f"{c}{k}" for c in ("_", "_list", "_ok") for k in range(1, 5)])


def kind_of(type_name: Column, value: Column) -> Column:
    """string, number, boolean, array, object or null from a type name; without one a value counts as text."""
    return (
        F.when(type_name.startswith("ARRAY"), "array").when(type_name.startswith("OBJECT"), "object").when(type_name == "STRING", "string")
        .when(type_name == "BOOLEAN", "boolean").when(type_name == "VOID", "null").when(type_name.isNotNull(), "number").when(value.isNotNull(), "string")
    )


def with_kinds(df: DataFrame, raw: str) -> DataFrame:
    """df with the recovered text (_txt), its map (_obj) and the kind of each known key's value (_kind_<key>), each made once."""
    keys = (*REQUIRED, *OTHERS)
    # All values at once; null where the text has no variant (equal keys, NaN).
    values = F.try_variant_get(F.try_parse_json("_txt"), "$", "map<string,variant>")
    df = with_recovery(df, raw).withColumn("_values", values)
    df = df.withColumns({f"_type_{k}": F.schema_of_variant(F.try_element_at("_values", F.lit(k))) for k in keys})
    df = df.withColumns({f"_kind_{k}": F.when(F.map_contains_key("_obj", k), kind_of(F.col(f"_type_{k}"), F.col("_obj")[k])) for k in keys})
    return df.drop("_values", *[f"_type_{k}" for k in keys])


def truthy(kind: Column, value: Column) -> Column:
    """Whether a value counts as true: any text but the empty one, any number but zero, any list or object with something in it."""
    return F.coalesce(
        F.when(kind == "boolean", F.lower(value) == "true").when(kind == "string", value != "").when(kind == "number", value.try_cast("double") != 0)
        .when(kind.isin("array", "object"), ~value.isin("[]", "{}")), F.lit(False),
    )


def text_list(*keys: str) -> Column:
    """The value of the first of the keys that is there, as texts; empty if that is no list."""
    out = F.array().cast("array<string>")
    for k in reversed(keys):
        listed = F.when(F.col(f"_kind_{k}") == "array", F.from_json(F.col("_obj")[k], "array<string>"))
        out = F.when(F.map_contains_key("_obj", k), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>"))


def _listed(names: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))


def schema_warnings() -> Column:
    """F20 over the columns of with_kinds: what a grade object lacks or has too much, as warning texts in a fixed order."""
    keys = F.map_keys("_obj")
    lacking = F.array_except(F.array(*map(F.lit, REQUIRED)), keys)

    def looks_like(k: Column) -> Column:
        n = F.lower(strip(k))
        alike = F.contains(n, F.lit("revisao_necess")) | (F.startswith(n, F.lit("criterios_")) & ~n.isin("criterios_atendidos", "criterios_ausentes"))
        return ~n.isin(*REQUIRED) & alike

    odd = F.filter(keys, looks_like)

    def wrong(key: str, *kinds: str) -> Column:
        return F.when(F.array_contains(keys, key) & ~F.coalesce(F.col(f"_kind_{key}").isin(*kinds), F.lit(False)), f"Campo {key} com tipo inválido.")

    return F.array_compact(
        F.array(
            F.when(F.size(lacking) > 0, F.concat(F.lit("JSON recuperado, mas schema incompleto: chaves ausentes: "), _listed(lacking))),
            F.when(F.size(odd) > 0, F.concat(F.lit("Chaves suspeitas/ignoradas: "), _listed(odd))),
            F.when(F.array_contains(keys, "analysis") | F.array_contains(keys, "reasoning"), "Campos proibidos detectados: analysis/reasoning."),
            wrong("comentario", "string"), wrong("criterios_atendidos", "array"), wrong("criterios_ausentes", "array"),
            wrong("nota", "number", "string", "boolean"),
        )
    )


def strict_boolean(kind: Column, value: Column) -> Column:
    """struct(value, invalid)."""
    t = F.lower(strip(value))
    number = value.try_cast("double")
    truth = (
        F.when(kind == "boolean", t == "true").when((kind == "string") & t.isin("true", "false"), t == "true")
        .when(kind == "number", number != 0).when(kind.isin("array", "object"), ~value.isin("[]", "{}")).otherwise(True)
    )
    clean = F.coalesce((kind == "boolean") | ((kind == "string") & t.isin("true", "false")), F.lit(False))
    return F.struct(F.coalesce(truth, F.lit(True)).alias("value"), (~clean).alias("invalid"))
