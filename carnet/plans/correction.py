"""Abbreviation dictionaries and corpus correction queries."""

from pyspark.sql import functions as F

from carnet import constants as K
from carnet.functions import text as T
from carnet.lookups import as_lookup
from carnet.operators import abbrev as A
from carnet.operators import correct as C
from carnet.plans import inputs as I
from carnet.plans import sqlparts as S
from carnet.plans.vocabulary import SQL_ALL, SQL_SPELL, all_suggestions, spell_dictionary, stored_suggestions
from carnet.registry import query, table

SQL_UNESCAPE = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"


def sql_words_to_commas(x):
    """'a ou b' to 'a , b': RE2 has no Unicode word boundary, so neighbours are matched; twice for overlaps."""
    once = rf"regexp_replace({x}, '(^|[^{S.W}])(ou|or)([^{S.W}]|$)', '\1,\3', 'gi')"
    return once.replace("{x}", x) if "{x}" in once else once


def sql_split(x, clean):
    replaced = sql_words_to_commas(sql_words_to_commas(clean(x)))
    parts = rf"list_filter(list_transform(regexp_split_to_array({replaced}, '\s*[,;/|–—]\s*'), lambda p: {clean('p')}), lambda p: p <> '')"
    return parts


def sql_clean(x):
    step = SQL_UNESCAPE.format(x=x)
    step = rf"regexp_replace({step}, '(?is)<ref[^>]*>.*?</ref>', '', 'g')"
    step = rf"regexp_replace({step}, '\[\[|\]\]', '', 'g')"
    step = rf"regexp_replace({step}, '\{{\{{.*?\}}\}}', '', 'g')"
    step = rf"regexp_replace({step}, '\[\s*\d+\s*\]', '', 'g')"
    return rf"regexp_replace(trim(regexp_replace({step}, '{S.SP}+', ' ', 'g')), '[ ,;.]+$', '')"


def sql_raw_clean(x):
    return S.strip(rf"regexp_replace({SQL_UNESCAPE.format(x=x)}, '\[\s*\d+\s*\]', '', 'g')")


def dedup(x):
    return f"list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda w: lower(w)), lower(v)) = i)"


KEY_PART = r"regexp_extract(line, '^([^:]+?)\s*:', 1)"
ITEM_FROM, ITEM_TO = r'<li><a href="/([^"]*)">([^<]*)</a></li>', r"<li><b>\1</b> : \2, or long \2</li>"


@query("abbr_harvest", rf"""
    WITH p AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '{ITEM_FROM}', '{ITEM_TO}', 'g'), '(?is)<li>(.*?)</li>', 1) AS items FROM pages),
    i AS (SELECT page_id, u.pos, trim(regexp_replace({SQL_UNESCAPE.format(x="regexp_replace(u.item, '<[^>]*>', '', 'g')")}, '{S.SP}+', ' ', 'g')) AS line
          FROM p, unnest(items) WITH ORDINALITY AS u(item, pos)),
    k AS (SELECT page_id, pos, upper(replace(regexp_replace({SQL_UNESCAPE.format(x=KEY_PART)}, '{S.SP}+', '', 'g'), 'ß', 'ss')) AS key,
                 {sql_split(r"regexp_extract(line, '^[^:]+:\s*(.+)$', 1)", sql_clean)} AS parts
          FROM i WHERE regexp_matches(line, '^[^:]+:.*\S')),
    d AS (SELECT page_id, pos, key, {dedup('parts')} AS exps FROM k),
    l AS (SELECT key, exps, row_number() OVER (PARTITION BY key ORDER BY page_id DESC, pos DESC) AS r FROM d WHERE key <> '' AND length(key) <= 20 AND len(exps) > 0)
    SELECT key, array_to_string(exps, ' | ') AS expansions,
           CASE WHEN len(exps) = 1 AND key NOT IN ('SP', 'SU', 'RCP') THEN 'sure' ELSE 'ambiguous' END AS kind FROM l WHERE r = 1""")
def abbr_harvest(spark, d):
    """The pages' navigation links are rewritten as 'KEY : expansion' items first."""
    html = F.regexp_replace("html", ITEM_FROM, r"<li><b>$1</b> : $2, or long $2</li>")
    found = A.harvest(table(spark, d, "pages").select("page_id", html.alias("html")), "page_id", "html")
    return found.withColumn("expansions", F.array_join("expansions", " | "))


def found_abbreviations(spark, d):
    """A second source: acronyms by first letter, sure up to M, ambiguous after."""
    keys = I.acronyms(table(spark, d, "documents"))
    low = F.lower("key")
    early = F.substring("key", 1, 1) <= "M"
    sure = keys.where(early).withColumn("value", F.concat(F.lit("found "), low))
    amb = keys.where(~early).withColumn("expansions", F.array(F.concat(F.lit("FIRST "), low), F.concat(F.lit("third "), low)))
    return sure, amb


SQL_FOUND = """
    fsure AS (SELECT key, 'found ' || lower(key) AS value FROM acr WHERE left(key, 1) <= 'M'),
    famb AS (SELECT key, ['FIRST ' || lower(key), 'third ' || lower(key)] AS expansions FROM acr WHERE left(key, 1) > 'M')"""


@query("abbr_merge", f"""
    WITH {I.SQL_ABBREVIATIONS}, {SQL_FOUND},
    s AS (SELECT key, coalesce(l.value, r.value) AS value FROM sure l FULL JOIN fsure r USING (key) WHERE key NOT IN ('SP', 'SU', 'RCP')),
    a AS (SELECT key, array_to_string(coalesce(l.expansions, r.expansions), ' | ') AS value FROM amb l FULL JOIN famb r USING (key) WHERE key NOT IN (SELECT key FROM s))
    SELECT 'sure' AS kind, key, value FROM s UNION ALL SELECT 'ambiguous', key, value FROM a""")
def abbr_merge(spark, d):
    fsure, famb = found_abbreviations(spark, d)
    lsure, lamb = I.abbreviations(spark, d)
    sure, amb = A.merge(lsure, fsure, lamb, famb)
    sure = sure.select(F.lit("sure").alias("kind"), "key", "value")
    return sure.unionByName(amb.select(F.lit("ambiguous").alias("kind"), "key", F.array_join("expansions", " | ").alias("value")))


BLACK = S.words_in(sorted({*K.AMBIGUOUS_KEY_BLACKLIST, *K.FUNCTION_WORDS}))
SQL_ACCEPT = rf"""CASE WHEN trim({{k}}) = '' OR lower(trim({{k}})) IN {BLACK} THEN NULL
    WHEN regexp_matches(trim({{k}}), '\p{{{{Ll}}}}') AND NOT regexp_matches(trim({{k}}), '\p{{{{Lu}}}}') THEN CASE WHEN trim({{k}}) IN {S.words_in(K.LOWER_KEY_WHITELIST)} THEN trim({{k}}) END
    WHEN regexp_matches(upper(replace(trim({{k}}), 'ß', 'ss')), '^[A-Z0-9]{{{{2,6}}}}$') THEN upper(replace(trim({{k}}), 'ß', 'ss')) END"""


@query("abbr_merge_lists", f"""
    WITH {I.SQL_ABBREVIATIONS}, {SQL_FOUND},
    b AS (SELECT {SQL_ACCEPT.format(k='key')} AS key, expansions AS l FROM amb), o AS (SELECT {SQL_ACCEPT.format(k='key')} AS key, expansions AS r FROM famb),
    j AS (SELECT key, list_concat(coalesce(l, []), coalesce(r, [])) AS x FROM (SELECT * FROM b WHERE key IS NOT NULL) FULL JOIN (SELECT * FROM o WHERE key IS NOT NULL) USING (key))
    SELECT key, array_to_string({dedup('x')}, ' | ') AS expansions FROM j""")
def abbr_merge_lists(spark, d):
    _, famb = found_abbreviations(spark, d)
    merged = A.merge_lists(I.abbreviations(spark, d)[1], famb)
    return merged.withColumn("expansions", F.array_join("expansions", " | "))


@query("abbr_accept_key", rf"""
    SELECT DISTINCT t AS token, {SQL_ACCEPT.format(k='t')} AS accepted
    FROM (SELECT unnest(list_filter(string_split(trim(regexp_replace(text, '{S.SP}+', ' ', 'g')), ' '), lambda x: x <> '')) AS t FROM documents)""")
def abbr_accept_key(spark, d):
    tokens = table(spark, d, "documents").select(F.explode(F.array_distinct(I.raw_tokens(F.col("text")))).alias("token")).distinct()
    return tokens.withColumn("accepted", A.accept_key(F.col("token")))


@query("abbr_split", f"""
    WITH p AS (SELECT conv_id, turn, {sql_split('text', sql_raw_clean)} AS parts FROM conversations)
    SELECT conv_id, turn, array_to_string({dedup('parts')}, ' | ') AS expansions FROM p""")
def abbr_split(spark, d):
    notes = table(spark, d, "conversations")
    return notes.select("conv_id", "turn", F.array_join(A.split_raw(F.col("text")), " | ").alias("expansions"))


SQL_BATCH = """
    SELECT doc_id, string_agg(coalesce(value, t), ' ' ORDER BY p) || ' ' AS corrected
    FROM (SELECT doc_id, u.t, u.p FROM documents, unnest(regexp_split_to_array(text, '[ /,.-]')) WITH ORDINALITY AS u(t, p)) LEFT JOIN {dict} ON key = t GROUP BY doc_id"""


@query("corr_dict_batch", f"WITH {I.SQL_REFERENCE}, {I.SQL_DICTIONARY} {SQL_BATCH.format(dict='dict')}")
def corr_dict_batch(spark, d):
    return C.correct_tokens(table(spark, d, "documents"), ["doc_id"], "text", I.correction_dictionary(spark, d))


@query("spell_apply", f"WITH {SQL_SPELL} {SQL_BATCH.format(dict='spell')}")
def spell_apply(spark, d):
    return C.correct_tokens(table(spark, d, "documents"), ["doc_id"], "text", spell_dictionary(spark, d))


SQL_BOUNDED = rf"list_filter(regexp_extract_all(lower(text), '[{S.W}]+[''’]?'), lambda x: NOT regexp_matches(x, '[''’]$'))"


@query("corr_occ", f"""
    WITH {I.SQL_REFERENCE}, {I.SQL_DICTIONARY}
    SELECT doc_id, key, value, count(*) AS occ FROM (SELECT doc_id, unnest({SQL_BOUNDED}) AS key FROM documents) JOIN dict USING (key) GROUP BY ALL""")
def corr_occ(spark, d):
    return C.occurrences(table(spark, d, "documents"), ["doc_id"], "text", C.with_patterns(as_lookup(I.correction_dictionary(spark, d))))


SQL_PHRASE_COUNTS = rf"""
    p AS (SELECT doc_id, u.piece, u.pos FROM documents, unnest(regexp_extract_all(text, '[{S.W}]+|[^{S.W}]+')) WITH ORDINALITY AS u(piece, pos)),
    g AS (SELECT doc_id, pos, lower(piece) AS a, lead(piece, 1) OVER w AS sep, lower(lead(piece, 2) OVER w) AS b, coalesce(lead(piece, 3) OVER w, '') AS nxt FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    h AS (SELECT doc_id, key, value, pos - 2 * row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS run FROM g JOIN phrases ON key = a || ' ' || b
          WHERE regexp_matches(sep, '^{S.SP}+$') AND NOT regexp_matches(nxt, '^[''’]')),
    n AS (SELECT doc_id, key, value, run, (count(*) + 1) // 2 AS hits FROM h GROUP BY ALL),
    phrase_counts AS (SELECT doc_id, key, value, CAST(sum(hits) AS BIGINT) AS occ FROM n GROUP BY ALL)"""


@query("corr_occ_phrase", f"WITH {I.SQL_PHRASES}, {SQL_PHRASE_COUNTS} SELECT * FROM phrase_counts")
def corr_occ_phrase(spark, d):
    return C.phrase_occurrences(table(spark, d, "documents"), ["doc_id"], "text", as_lookup(I.phrase_dictionary(spark, d)))


MARK = "chr(57344)"


def sql_bounded(x, pattern, replacement, flags="gi", after="''’"):
    """Whole-word replacement without look-around: neighbours are matched and put back, twice for adjacent hits."""
    edge = rf"'(^|[^{S.W}])' || {pattern} || '([^{S.W}{after}]|$)'"
    once = f"regexp_replace({x}, {edge}, '\\1' || {MARK} || '\\2', '{flags}')"
    twice = f"regexp_replace({once}, {edge}, '\\1' || {MARK} || '\\2', '{flags}')"
    return f"replace({twice}, {MARK}, {replacement})"


def sql_unit(x, pattern, replacement):
    once = rf"regexp_replace({x}, '(^|[^{S.W}]){pattern}([^{S.W}]|$)', '{replacement}', 'gi')"
    return rf"regexp_replace({once}, '(^|[^{S.W}]){pattern}([^{S.W}]|$)', '{replacement}', 'gi')"


def sql_time_units(x):
    x = sql_unit(x, r"(\d+)\s*/\s*j", r"\1\2 / jour\3")
    x = sql_unit(x, r"(q{1,2}u?e?l?q?u?e?s?|qqs?|qques)\s*j", r"\1quelques jours\3")
    return sql_unit(x, r"(\d+)\s*j", r"\1\2 jours\3")


SQL_PHRASE_HITS = rf"""
    pc AS (SELECT doc_id, u.piece, u.pos FROM documents, unnest(regexp_extract_all(text, '[{S.W}]+|[^{S.W}]+')) WITH ORDINALITY AS u(piece, pos)),
    g AS (SELECT doc_id, lower(piece) AS a, lead(piece, 1) OVER w AS sep, lower(lead(piece, 2) OVER w) AS b, coalesce(lead(piece, 3) OVER w, '') AS nxt FROM pc WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    ph AS (SELECT DISTINCT doc_id, key, value FROM g JOIN phrases ON key = a || ' ' || b WHERE regexp_matches(sep, '^{S.SP}+$') AND NOT regexp_matches(nxt, '^[''’]'))"""


@query("corr_apply", rf"""
    WITH {I.SQL_REFERENCE}, {I.SQL_DICTIONARY}, {I.SQL_PHRASES}, {SQL_PHRASE_HITS},
    wd AS (SELECT DISTINCT doc_id, key, value FROM (SELECT doc_id, unnest({SQL_BOUNDED}) AS key FROM documents) JOIN dict USING (key)),
    pairs AS (SELECT doc_id, list({{'txt': '', 'src': replace(key, ' ', '\s+'), 'dst': value}} ORDER BY length(key) DESC, key) AS ps FROM (SELECT * FROM wd UNION ALL SELECT * FROM ph) GROUP BY doc_id),
    r AS (SELECT doc_id, CASE WHEN ps IS NULL THEN text ELSE list_reduce(list_prepend({{'txt': text, 'src': '', 'dst': ''}}, ps),
              lambda acc, p: {{'txt': {sql_bounded('acc.txt', 'p.src', 'p.dst')}, 'src': '', 'dst': ''}}).txt END AS t FROM documents LEFT JOIN pairs USING (doc_id))
    SELECT doc_id, {sql_time_units('t')} AS corrected FROM r""")
def corr_apply(spark, d):
    """Words and phrases of both dictionaries applied to every document that holds them."""
    docs = table(spark, d, "documents")
    entries = as_lookup(I.correction_dictionary(spark, d).unionByName(I.phrase_dictionary(spark, d)))
    return C.apply_corrections(docs, ["doc_id"], "text", C.occurrences(docs, ["doc_id"], "text", C.with_patterns(entries)))


@query("corr_patient_sug", SQL_ALL + rf""", {I.SQL_PHRASES}, {SQL_PHRASE_COUNTS},
    listed AS (SELECT DISTINCT CASE category WHEN 'MANUAL_DICT' THEN 'DICT' ELSE category END AS family, lower(token_source) AS key, match AS value FROM allsug
               WHERE category IN ('MANUAL_DICT', 'TYPO', 'DIACRITICS_STRICT', 'DIACRITICS_MULTI', 'ABBREV_CANDIDATE', 'ENRICH_METIER') AND lower(token_source) NOT IN ('nan', 'none', 'null')),
    entries AS MATERIALIZED (SELECT 'DICT' AS family, key, value FROM dict UNION SELECT family, key, value FROM listed),
    cs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{S.W}]+')) AS form FROM documents),
    w AS (SELECT doc_id, form, count(*) AS occ FROM cs GROUP BY ALL),
    forms AS (SELECT key, array_to_string(expansions, ' / ') AS note, 1 AS prio, key AS form FROM amb
              UNION ALL SELECT key, array_to_string(expansions, ' / '), 2, upper(left(key, 1)) || lower(substr(key, 2)) FROM amb WHERE length(key) <= 4
              UNION ALL SELECT key, array_to_string(expansions, ' / '), 3, lower(key) FROM amb WHERE lower(key) IN {S.words_in(K.LOWER_MATCH_WHITELIST)}),
    a AS (SELECT doc_id, form, occ, note, row_number() OVER (PARTITION BY doc_id, key ORDER BY prio) AS r FROM w JOIN forms USING (form)),
    u AS (SELECT doc_id, family, key AS token_source, value AS match, count(*) AS patient_occ, NULL::VARCHAR AS note
          FROM (SELECT doc_id, unnest({SQL_BOUNDED}) AS key FROM documents) JOIN entries USING (key) GROUP BY doc_id, family, key, value
          UNION ALL SELECT doc_id, family, key, value, len(regexp_extract_all(lower(text), '(^|[^{S.W}])' || key || '([^{S.W}''’]|$)')), NULL
          FROM documents JOIN (SELECT * FROM entries WHERE regexp_matches(key, '^[{S.W}]+(-[{S.W}]+)+$')) ON regexp_matches(lower(text), '(^|[^{S.W}])' || key || '([^{S.W}''’]|$)')
          UNION ALL SELECT doc_id, 'PHRASE_DICT', key, value, occ, NULL FROM phrase_counts
          UNION ALL SELECT doc_id, 'ABBREV_SURE', key, value, occ, NULL FROM w JOIN sure ON key = form
          UNION ALL SELECT doc_id, 'ABBREV_AMBIGU', form, '', occ, 'Possibles : ' || note FROM a WHERE r = 1
          UNION ALL SELECT doc_id, 'NOISE', lower(form), '', sum(occ)::BIGINT, 'Artefact ETL (valeur manquante) – à ignorer' FROM w WHERE lower(form) IN ('nan', 'none', 'null') GROUP BY doc_id, lower(form))
    SELECT *, family || '::' || token_source || '::' || match AS suggestion_key, family IN {S.words_in([k for k, (_, auto) in K.FAMILIES.items() if auto])} AND match <> '' AS is_auto FROM u""")
def corr_patient_sug(spark, d):
    """Every family, with the suggestions on the vocabulary as the listed ones."""
    sure, ambiguous = I.abbreviations(spark, d)
    found = C.patient_suggestions(table(spark, d, "documents"), ["doc_id"], "text", as_lookup(I.correction_dictionary(spark, d)), I.phrase_dictionary(spark, d),
                                  sure, ambiguous, (*K.FAMILIES, "MANUAL_DICT"), stored_suggestions(spark, d))
    return C.in_reading_order(found, ["doc_id"])


@query("corr_family_select", SQL_ALL + f"SELECT token_source, category FROM allsug WHERE category IN {S.words_in(K.DEFAULT_FAMILIES)}")
def corr_family_select(spark, d):
    return all_suggestions(spark, d).where(F.col("category").isin(*K.DEFAULT_FAMILIES)).select("token_source", "category")


@query("abbr_annotate", rf"""
    WITH {I.SQL_ABBREVIATIONS},
    m AS (SELECT DISTINCT doc_id, key, expansions[1] AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{S.W}]+')) AS key FROM documents) JOIN amb USING (key)),
    pairs AS (SELECT doc_id, list({{'txt': '', 'src': key, 'dst': key || ' [' || value || ']'}} ORDER BY key) AS ps FROM m GROUP BY doc_id),
    b AS (SELECT doc_id, ps, CASE WHEN ps IS NULL THEN text ELSE list_reduce(list_prepend({{'txt': text, 'src': '', 'dst': ''}}, ps), lambda acc, p:
              {{'txt': regexp_replace(acc.txt, '(^|[^{S.W}])' || p.src || '\s*\[[^\]\r\n]*\]', '\1' || p.src, 'g'), 'src': '', 'dst': ''}}).txt END AS t FROM documents LEFT JOIN pairs USING (doc_id))
    SELECT doc_id, CASE WHEN ps IS NULL THEN t ELSE list_reduce(list_prepend({{'txt': t, 'src': '', 'dst': ''}}, ps), lambda acc, p:
        {{'txt': {sql_bounded('acc.txt', 'p.src', 'p.dst', 'g', '')}, 'src': '', 'dst': ''}}).txt END AS annotated FROM b""")
def abbr_annotate(spark, d):
    """The first expansion of every ambiguous abbreviation is written after it."""
    docs = table(spark, d, "documents")
    first = as_lookup(I.abbreviations(spark, d)[1].select("key", F.get("expansions", F.lit(0)).alias("value")))
    met = C.occurrences(docs, ["doc_id"], "text", C.with_patterns(first, ignore_case=False))
    return C.annotate_abbreviations(docs, ["doc_id"], "text", met)


@query("match_spans", rf"""
    WITH {I.SQL_REFERENCE}, {I.SQL_DICTIONARY},
    p AS (SELECT doc_id, u.piece, u.pos FROM documents, unnest(regexp_extract_all(text, '[{S.W}]+|[^{S.W}]+')) WITH ORDINALITY AS u(piece, pos)),
    s AS (SELECT doc_id, piece, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS "end" FROM p)
    SELECT doc_id, "end" - length(piece) AS start, "end", piece AS matched, key, value FROM s JOIN dict ON key = lower(piece)""")
def match_spans(spark, d):
    return C.match_spans(table(spark, d, "documents"), ["doc_id"], "text", as_lookup(I.correction_dictionary(spark, d)))


@query("match_spans_phrase", rf"""
    WITH {I.SQL_PHRASES},
    p AS (SELECT doc_id, u.piece, u.pos FROM documents, unnest(regexp_extract_all(text, '[{S.W}]+|[^{S.W}]+')) WITH ORDINALITY AS u(piece, pos)),
    o AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS upto FROM p),
    g AS (SELECT doc_id, pos, upto - length(piece) AS start, lower(piece) AS a, lead(piece, 1) OVER w AS sep, lower(lead(piece, 2) OVER w) AS b, lead(upto, 2) OVER w AS "end", coalesce(lead(piece, 3) OVER w, '') AS nxt
          FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    h AS (SELECT *, pos - 2 * row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS run FROM g JOIN phrases ON key = a || ' ' || b
          WHERE regexp_matches(sep, '^{S.SP}+$') AND NOT regexp_matches(nxt, '^[''’]')),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key, run ORDER BY pos) AS nth FROM h)
    SELECT doc_id, start, "end", substr(text, start + 1, "end" - start) AS matched, key, value FROM k JOIN documents USING (doc_id) WHERE nth % 2 = 1""")
def match_spans_phrase(spark, d):
    """Every place of every phrase; occurrences of one phrase do not overlap."""
    return C.match_spans(table(spark, d, "documents"), ["doc_id"], "text", as_lookup(I.phrase_dictionary(spark, d)), guard=True)


@query("noise_count", rf"""
    SELECT doc_id, lower(t) AS token, count(*) AS occ FROM (SELECT doc_id, unnest(regexp_extract_all(replace(text, ' the ', ' None '), '[{S.W}]+')) AS t FROM documents)
    WHERE lower(t) IN ('nan', 'none', 'null') GROUP BY ALL""")
def noise_count(spark, d):
    """Every lower-case 'the' stands for an exported missing value."""
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(" the "), F.lit(" None ")).alias("text"))
    return C.noise_counts(docs, ["doc_id"], "text")
