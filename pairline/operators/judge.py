"""Judge output: parsing of free text, repair of near-JSON, validation, prompt rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairline.functions import text as tx
from pairline.functions.hashing import hash_long
from pairline.operators.infer import Batch, batch_infer
from pairline.sources.scratch import cut

DELIMITER = "||V^=^V||"
RATE_LIMITED = "rate_limit_exceeded"
PARSED = "struct<score:array<double>,reasoning:string,method:string>"


def delimiter_count(c: Column) -> Column:
    return F.when(~F.contains(c, F.lit(DELIMITER)), 0).otherwise(F.size(F.split(c, r"\|\|V\^=\^V\|\|", -1)) - 1)


def between_delimiters(c: Column) -> Column:
    return F.get(F.split(c, r"\|\|V\^=\^V\|\|", -1), F.lit(1))


def braced(c: Column) -> Column:
    """From the first { to the last }; null without a pair."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def bracketed_pair(c: Column) -> Column:
    """From the first [ to the last ] if it is a list of two whole numbers."""
    inside = F.regexp_extract(c, r"(?s)\[.*\]", 0)
    return F.when(inside.rlike(r"^\[[0-9]+, ?[0-9]+\]$"), F.transform(F.split(F.btrim(inside, F.lit("[]")), ", ?"), lambda x: x.try_cast("double")))


def is_score(c: Column) -> Column:
    """A whole number from 0 to 10 and nothing else."""
    return F.coalesce(tx.py_strip(c).rlike(r"^[+-]?[0-9]+$") & F.coalesce(tx.py_strip(c).try_cast("bigint").between(0, 10), F.lit(False)), F.lit(False))


def repair_json(c: Column) -> Column:
    """The first object with bare keys quoted, bare strings quoted and bare numbers put in brackets; true, false and null stay."""
    first = F.regexp_extract(c, r"(?s)\{.*?\}", 0)
    keys = F.regexp_replace(first, r"([{,]\s*)([A-Za-z_][A-Za-z_0-9]*)\s*:", '$1"$2":')
    numbers = F.regexp_replace(keys, r":\s*(-?[0-9]+(?:\.[0-9]+)?)\s*(?=[,}])", ": [$1]")
    return F.nullif(F.regexp_replace(numbers, r':\s*(?!(?:true|false|null)\s*[,}])([A-Za-z][^,}"\[\]{]*?)\s*(?=[,}])', ': "$1"'), F.lit(""))


def _scores(value: Column) -> Column:
    """The score list of an object, a single score as a list of one."""
    many = F.try_variant_get(value, "$.score", "array<double>")
    one = F.try_variant_get(value, "$.score", "double")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)))


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once a row, however often f names it."""
    return F.transform(F.array(c), f)[0]


def parse_judge_output(c: Column, give_up: bool = False, seed: str = "judge", key: Column | None = None) -> Column:
    """struct(score, reasoning, method) of a judge's answer, by the first stage that applies.

    method: rate_limited, edit (returned unchanged), json, repaired, guessed, list, number or failed. With give_up an answer
    without braces gets a seeded guess, also where it holds a valid list.
    """
    inner = F.when(delimiter_count(c) == 2, between_delimiters(c)).otherwise(braced(c))
    guess = F.array(F.pmod(hash_long(seed, key if key is not None else c), F.lit(11)).cast("double"))

    def out(score: Column | None, why: Column | None, method: str) -> Column:
        return F.struct((score if score is not None else F.lit(None).cast("array<double>")).alias("score"), (why if why is not None else F.lit(None).cast("string")).alias("reasoning"), F.lit(method).alias("method"))

    def reason(value: Column) -> Column:
        return F.try_variant_get(value, "$.reasoning", "string")

    def repaired(fixed: Column) -> Column:
        value = F.try_parse_json(fixed)
        return _bound(value, lambda v: F.when(_scores(v).isNotNull(), out(_scores(v), reason(v), "repaired")).otherwise(out(None, None, "failed")))

    def parsed(clean: Column) -> Column:
        def staged(v: Column) -> Column:
            edit = F.contains(clean, F.lit("edit")) & F.try_variant_get(v, "$.edit", "variant").isNotNull()
            return _bound(_scores(v), lambda scores: F.when(edit, out(scores, clean, "edit")).when(scores.isNotNull(), out(scores, reason(v), "json")).otherwise(_bound(repair_json(clean), repaired)))

        return _bound(F.try_parse_json(clean), staged)

    bare = F.when(F.lit(give_up), out(guess, None, "guessed")).when(bracketed_pair(c).isNotNull(), out(bracketed_pair(c), None, "list"))
    bare = bare.when(is_score(c), out(F.array(tx.py_strip(c).try_cast("double")), None, "number")).otherwise(out(None, None, "failed"))
    found = _bound(inner, lambda i: F.when(i.isNull(), bare).otherwise(_bound(F.replace(tx.py_strip(i), F.lit("\n"), F.lit("")), parsed)))
    return F.when(c.isNull(), out(None, None, "failed")).when(c == RATE_LIMITED, out(None, None, "rate_limited")).otherwise(found)


def score_with_retry(df: DataFrame, init: Callable[[], Callable[[Batch, int], Batch]], keys: list[str], seed: str = "again") -> DataFrame:
    """df with the judge's scores `sc` and `pq`, and `attempt`: where one of a row's two answers has none, both are asked for again.

    init() gives a function of (batch, attempt) that returns the batch with the texts sc_answer and pq_answer. An answer
    that fails at the second attempt as well is a guess from the row's keys. A judge that refuses for its rate has no score.
    The first answers are written to the shared folder, so that no row is judged more often than that.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", sc_answer string, pq_answer string"
    each = ("sc", "pq")

    def ask(rows: DataFrame, attempt: int) -> DataFrame:
        def once():
            model = init()
            return lambda batch: model(batch, attempt)

        return batch_infer(rows, once, schema).withColumn("attempt", F.lit(attempt))

    def parsed(rows: DataFrame, give_up: bool) -> DataFrame:
        return rows.withColumns({f"__{s}": parse_judge_output(F.col(f"{s}_answer"), give_up, f"{seed}:{s}", F.concat_ws(":", *keys)) for s in each})

    first = cut(parsed(ask(df, 1), give_up=False), "judged")
    failed = (F.col("__sc.method") == "failed") | (F.col("__pq.method") == "failed")
    second = parsed(ask(first.where(failed).select(*df.columns), 2), give_up=True)
    both = first.where(~failed).unionByName(second)
    return both.select(*df.columns, *[F.col(f"__{s}.score").alias(s) for s in each], "attempt")


def validate_scores(c: Column) -> dict[str, Column]:
    """Predicates over an answer: two delimiters, one whole score, a list of scores, named scores in order."""
    inside = F.regexp_extract(c, r"^\s*\[(.*)\]\s*$", 1)
    parts = F.split(inside, ",", -1)
    named = F.transform(parts, lambda p, i: F.coalesce(F.regexp_extract(p, r"^\s*score([0-9]+)\s*:", 1).try_cast("int") == i + 1, F.lit(False)) & is_score(F.regexp_extract(p, r":(.*)$", 1)))
    return {
        "two_delimiters": delimiter_count(c) == 2,
        "whole_score": is_score(c),
        "score_list": (inside != "") & F.forall(parts, is_score),
        "named_scores": (inside != "") & F.forall(named, lambda x: x),
    }


# Own wording of the judge's templates; the rules mark their input with <prompt> or <instruction>.
CONTEXT_TEXT = "You judge generated pictures. Answer with JSON that holds a list `score` and a text `reasoning`."
RULES = {"t2i": "Score from 0 to 10 how well the picture shows: <prompt>", "tie": "Score from 0 to 10 how well the edit follows: <instruction>", "t2v": "Score from 0 to 10 how well the film shows: <prompt>"}


def render_judge_prompt(df: DataFrame, rules: DataFrame, text_col: str) -> DataFrame:
    """df with the prompt of its task: context, rule, and the row's text in the rule's mark; rules (task, rule) are few."""
    joined = df.join(F.broadcast(rules), "task")
    filled = F.replace(F.replace("rule", F.lit("<prompt>"), F.col(text_col)), F.lit("<instruction>"), F.col(text_col))
    return joined.withColumn("judge_prompt", F.concat_ws("\n", F.lit(CONTEXT_TEXT), filled)).drop("rule")


def scores_map_to_rows(df: DataFrame, column: str = "scores_json", key: str = "folder") -> DataFrame:
    """One row for each seed of a JSON object {seed: {sementics_score, quality_score, overall_score}}."""
    # the misspelt name is that of the files
    schema = "map<string,struct<sementics_score:double,quality_score:double,overall_score:double>>"
    each = df.select(key, F.explode(F.from_json(column, schema)).alias("seed", "s"))
    return each.select(key, F.col("seed").try_cast("bigint").alias("seed"), F.col("s.sementics_score").alias("semantics_score"), "s.quality_score", "s.overall_score")
