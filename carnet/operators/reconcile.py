"""Joins between sources: diagnosis comparison, correction state, patient texts, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnet.functions import text as T


def distinct_concat(df: DataFrame, key: str, item: str, sep: str = " | ", alias: str | None = None) -> DataFrame:
    """Distinct items per key joined in order. Repeats go away first, so a group holds at most the catalogue of items."""
    dedup = df.where(F.trim(item) != "").select(key, F.trim(item).alias(item)).distinct()
    return dedup.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(item)), sep).alias(alias or item))


def diagnosis_comparison(inclusion: DataFrame, sheet: DataFrame, notes: DataFrame, codes: DataFrame, validations: DataFrame) -> DataFrame:
    """Structured diagnosis, note diagnoses, coded diagnoses and validation of every included patient, side by side.
    Sides are aggregated to one row per patient before they are joined."""
    from carnet.operators.records import diagnosis_flag

    by_sheet = sheet.select(F.col("num_inclusion").alias("id_patiente"), diagnosis_flag(F.col("target")).alias("diag_recueil"))
    mapped = notes.join(inclusion, "ipp").select(F.col("num_inclusion").alias("id_patiente"), "diag_gyneco")
    by_notes = distinct_concat(mapped, "id_patiente", "diag_gyneco")
    by_codes = distinct_concat(codes.withColumnRenamed("num_inclusion", "id_patiente"), "id_patiente", "diag_item", alias="diag_pmsi")
    out = inclusion.select(F.col("num_inclusion").alias("id_patiente"))
    for side in (by_sheet, by_notes, by_codes, validations):
        out = out.join(side, "id_patiente", "left")
    return out


def align_ids(sheet: DataFrame, notes: DataFrame, key: str, features: list[str], max_missing: int = 80) -> tuple[DataFrame, DataFrame]:
    """Both sides restricted to the ids present in both, after dropping sheet rows with too many missing cells."""
    missing = sum((F.col(c).isNull().cast("int") for c in features), F.lit(0))
    complete = sheet.where(missing <= max_missing)
    return complete.join(notes.select(key).distinct(), key, "left_semi"), notes.join(complete.select(key).distinct(), key, "left_semi")


def keyword_stays(diagnoses: DataFrame, acts: DataFrame, stay: str, label: str, keyword: str, exceptions: DataFrame, extra: DataFrame) -> DataFrame:
    """Acts of the stays whose diagnosis names a keyword, with the distinct diagnoses of the stay; excluded stays go,
    cases known from elsewhere are added."""
    hits = diagnoses.where(F.lower(label).contains(keyword)).select(stay, label).distinct()
    listed = hits.groupBy(stay).agg(F.array_join(F.array_sort(F.collect_list(label)), " | ").alias("diagnosis"))
    kept = listed.join(exceptions.select(stay), stay, "left_anti")
    return acts.join(kept, stay).unionByName(extra, allowMissingColumns=True)


def occurrence_split(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with a flag: seen once or more than once."""
    return df.groupBy(value).agg((F.count("*") > 1).alias("repeated"))


def match_rate(a: DataFrame, b: DataFrame, key: str, variables: list[str]) -> DataFrame:
    """Share of equal values (NULL equals NULL) per variable between two sources: one join, one aggregate."""
    joined = a.alias("a").join(b.alias("b"), key)
    rates = joined.agg(*[F.round(F.avg(F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")).cast("double")), 6).alias(v) for v in variables])
    return rates.unpivot([], variables, "variable", "match_rate")


def compare_values(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Both sources' values of one variable side by side, as integers where possible."""
    joined = a.select(key, F.col(left).alias("__l")).join(b.select(key, F.col(right).alias("__r")), key)
    return joined.select(key, F.expr("try_cast(__l AS INT)").alias("left_value"), F.expr("try_cast(__r AS INT)").alias("right_value"))


def merge_by_priority(notes: DataFrame, sheet: DataFrame, key: str, variables: list[str], first: str = "notes") -> DataFrame:
    """All patients of both sources; where both have a value, the source named ``first`` wins."""
    joined = notes.alias("n").join(sheet.alias("s"), key, "full")
    pick = lambda v: F.coalesce(F.col(f"n.{v}"), F.col(f"s.{v}")) if first == "notes" else F.coalesce(F.col(f"s.{v}"), F.col(f"n.{v}"))
    return joined.select(key, *[pick(v).alias(v) for v in variables])


def present(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def patient_status(comparison: DataFrame, corrections: DataFrame, validations: DataFrame) -> DataFrame:
    """Status of each patient: a validated correction or diagnosis first, then the correction, then the comparison."""
    c = corrections.select("id_patiente", F.col("status_texte").alias("c_status"), F.col("validated_at").alias("c_valid"))
    v = validations.select("id_patiente", F.col("date_validation").alias("v_date"))
    joined = comparison.join(c, "id_patiente", "left").join(v, "id_patiente", "left")
    status = (F.when(present(F.col("c_valid")) | present(F.col("v_date")), "corrections_validees").when(present(F.col("c_status")), F.col("c_status"))
              .when(present(F.col("validation_statut")), F.col("validation_statut")).otherwise("attente_correction"))
    return joined.select("id_patiente", status.alias("status_texte"))


def latest_corrections(log: DataFrame) -> DataFrame:
    """Current correction of each patient from a change log (id_patiente, seq, action, text, user).

    A save replaces the text and resets the validation; a validation keeps the last saved text. Three aggregates in one
    pass: the last change, the last save, and the last validation.
    """
    last = F.max(F.struct("seq", "action", "user"))
    saved = F.max(F.when(F.col("action") == "save", F.struct("seq", "text")))
    current = log.groupBy("id_patiente").agg(last.alias("l"), saved.alias("s"))
    validated = F.col("l.action") == "validate"
    return current.select(
        "id_patiente", F.col("s.text").alias("texte_apres"), F.when(validated, "corrections_validees").otherwise("corrections_en_cours").alias("status_texte"),
        F.col("l.user").alias("updated_by"), F.when(validated, F.col("l.user")).alias("validated_by"), F.when(validated, F.col("l.seq")).alias("validated_seq"))


def before_after(comparison: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Text before (source) and after (saved correction, else source), without visual separators."""
    saved = corrections.select(key, T.strip_leading_label(F.col("texte_apres")).alias("__a"))
    joined = comparison.join(saved, key, "left")
    before = F.coalesce("text", F.lit(""))
    after = F.when(present(F.col("__a")), F.col("__a")).otherwise(before)
    return joined.select(key, T.strip_separators(before).alias("text_before"), T.strip_separators(after).alias("text_after"))


def source_texts(patients: DataFrame, comparison: DataFrame, mapping: DataFrame, raw: DataFrame) -> DataFrame:
    """Source text of each patient: the combined text if there is one, else the latest raw note found by the mapped id."""
    latest = raw.groupBy("ipp").agg(F.max(F.struct("note_date", "note_id", "text")).alias("n")).select("ipp", F.col("n.text").alias("__raw"))
    joined = patients.join(comparison.select("patient_id", F.col("text").alias("__c")), "patient_id", "left")
    joined = joined.join(mapping, "patient_id", "left").join(latest, "ipp", "left")
    return joined.select("patient_id", F.coalesce(F.when(present(F.col("__c")), F.trim("__c")), F.col("__raw"), F.lit("")).alias("text"))


def reset_sentences(saved: DataFrame, engine: DataFrame, resets: DataFrame, key: str) -> DataFrame:
    """Sentences ``idx`` of a saved text put back to the engine's sentences, all requests of a text together. The saved row goes away
    when the text then equals the engine's; a request outside either text is refused, and without another the saved text stays."""
    asked = resets.groupBy(key).agg(F.collect_set("idx").alias("__idx"))
    # Cut into sentences below the joins, once per text: inside a lambda the text would be cut again for each sentence.
    texts, engines = (df.select(key, F.col("text").alias(whole), T.sentences(F.col("text")).alias(parts)) for df, whole, parts in ((saved, "__s", "__mine"), (engine, "__e", "__theirs")))
    joined = texts.join(engines, key).join(asked, key, "left")
    mine, theirs = F.col("__mine"), F.col("__theirs")
    ends = F.least(F.size(mine), F.size(theirs))
    valid = F.coalesce(F.exists("__idx", lambda i: (i >= 0) & (i < ends)), F.lit(False))
    put_back = F.transform(mine, lambda s, i: F.when(F.array_contains("__idx", i) & (i < F.size(theirs)), F.get(theirs, i)).otherwise(s))
    done = joined.withColumn("__new", F.when(valid, T.join_sentences(put_back)).otherwise(F.col("__s"))).withColumn("__valid", valid)
    kept = done.where(~F.col("__valid") | (F.trim("__new") != F.trim("__e")))
    return kept.select(key, F.col("__new").alias("text"))
