"""The same results in plain SQL, written from the definitions, for checking in DuckDB.

Each query is a SELECT over named common table expressions; ``with_parts`` puts those it
needs, and those they need, in front of it.
"""

import re

# The default English stop words, without those that hold an apostrophe
# (words are cut at apostrophes, so those never occur).
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own same
so than too very s t can will just don should now cannot could ought would
""".split()
STOP_LIST = ", ".join(f"'{word}'" for word in STOP_WORDS)

WORD = r"'[\p{L}\p{N}_]+'"
WORD_2 = r"'[\p{L}\p{N}_]{2,}'"


def _money(name: str) -> str:
    return f"CAST(CAST({name} AS DECIMAL(18,2)) AS VARCHAR)"


def _text(name: str) -> str:
    return f"CAST({name} AS VARCHAR)"


# base: (slice value, row id, query-only slice, slice on both sides, columns)
BASES = {
    "customer": ("c_mktsegment", "c_custkey", "AUTOMOBILE", "BUILDING", [
        ("c_custkey", _text("c_custkey")), ("c_name", "c_name"),
        ("c_nationkey", "CASE WHEN c_nationkey <> 0 THEN CAST(c_nationkey AS VARCHAR) END"),
        ("c_acctbal", f"CASE WHEN c_acctbal >= 500 THEN {_money('c_acctbal')} END"),
        ("c_note", "CAST(NULL AS VARCHAR)"), ("c_mktsegment", "c_mktsegment")]),
    "orders": ("o_orderpriority", "o_orderkey", "1-URGENT", "2-HIGH", [
        ("o_orderkey", _text("o_orderkey")), ("o_custkey", _text("o_custkey")),
        ("o_orderstatus", "o_orderstatus"), ("o_totalprice", _money("o_totalprice")),
        ("o_orderdate",
         "CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END")]),
    "events": ("event_type", "event_id", "click", "error", [
        ("user_id", _text("user_id")), ("event_type", "event_type"), ("value", _money("value")),
        ("props", "props")]),
    "part": ("p_type", "p_partkey", "ECONOMY", "LARGE", [
        ("p_partkey", _text("p_partkey")), ("p_name", "CASE WHEN p_size > 5 THEN p_name END"),
        ("p_brand", "CASE WHEN p_brand = 'Brand#1' THEN ' ' ELSE p_brand END"),
        ("p_type", "p_type"), ("p_size", _text("p_size")),
        ("p_retailprice", _money("p_retailprice"))]),
    "documents": ("lang", "doc_id", "de", "en", [
        ("doc_id", _text("doc_id")), ("text", "text"), ("source", "source"),
        ("n_chars", _text("n_chars"))]),
    "supplier": ("'all'", "s_suppkey", "", "", [
        ("s_suppkey", _text("s_suppkey")), ("s_name", "s_name"),
        ("s_nationkey", _text("s_nationkey")), ("s_acctbal", _money("s_acctbal"))]),
    "nation": ("'all'", "n_nationkey", "", "", [
        ("n_nationkey", _text("n_nationkey")), ("n_name", "n_name"),
        ("n_regionkey", _text("n_regionkey"))]),
    "region": ("'all'", "r_regionkey", "", "", [
        ("r_regionkey", _text("r_regionkey")), ("r_name", "r_name")]),
}


def _names(position: int) -> str:
    return ", ".join(f"'{base}__{spec[position]}'" for base, spec in BASES.items() if spec[position])


CSV_COLUMNS = [(base, name, expr) for base, spec in BASES.items() for name, expr in spec[4]] + [
    ("lineitem", name, expr) for name, expr in [
        ("l_orderkey", _text("l_orderkey")), ("l_linenumber", _text("l_linenumber")), ("l_quantity", _money("l_quantity")),
        ("l_extendedprice", _money("l_extendedprice")), ("l_returnflag", "l_returnflag"),
        ("l_shipdate", "strftime(l_shipdate, '%Y-%m-%d')")]]
# Texts that a CSV reader takes as missing.
MISSING = ", ".join(f"'{token}'" for token in """
#N/A|#N/A N/A|#NA|-1.#IND|-1.#QNAN|-NaN|-nan|1.#IND|1.#QNAN|<NA>|N/A|NA|NULL|NaN|None|n/a|nan|null|
""".strip().split("|"))
CSV_SQL = f"""SELECT col_name, count(*) AS n_rows, count(value) AS n_values,
        count(DISTINCT value) AS n_distinct, CAST(coalesce(sum(strlen(value)), 0) AS BIGINT) AS n_bytes,
        min(value) AS least, max(value) AS most
    FROM (SELECT col_name, CASE WHEN value NOT IN ({MISSING}) THEN value END AS value FROM (""" + " UNION ALL ".join(
    f"SELECT '{name}' AS col_name, {expr} AS value FROM {base}" for base, name, expr in CSV_COLUMNS).replace(
    "'text' AS col_name", "'whole' || chr(10) || 'text' AS col_name") + ")) GROUP BY col_name"


PARTS: dict[str, str] = {
    "base_columns": "SELECT * FROM (VALUES " + ", ".join(
        f"('{base}', {pos}, '{name}', {str(pos == len(spec[4]) - 1).lower()})"
        for base, spec in BASES.items() for pos, (name, _) in enumerate(spec[4])
    ) + ") v(base, col_pos, col_name, is_last)",
    "tables": " UNION ".join(
        f"SELECT '{base}__' || {spec[0]} AS table_name, '{base}' AS base FROM {base}"
        for base, spec in BASES.items()),
    "sides": f"""SELECT 'lake' AS side, * FROM tables WHERE table_name NOT IN ({_names(2)})
        UNION ALL
        SELECT 'query' AS side, * FROM tables WHERE table_name IN ({_names(2)}, {_names(3)})""",
    "meta": """SELECT side, table_name, col_pos, col_name FROM sides JOIN base_columns USING (base)
        WHERE side = 'lake' OR NOT is_last""",
    "plain_cells": " UNION ALL ".join(
        f"SELECT '{base}__' || {spec[0]} AS table_name, {pos} AS col_pos, "
        f"CAST({spec[1]} AS BIGINT) AS row_id, {expr} AS value FROM {base}"
        for base, spec in BASES.items() for pos, (_, expr) in enumerate(spec[4])),
    "cells": """SELECT side, table_name, col_pos, col_name, row_id, value
        FROM meta JOIN plain_cells USING (table_name, col_pos)""",
    "families": "SELECT base, table_name FROM tables WHERE table_name NOT LIKE '%\\_\\_all' ESCAPE '\\'",
    "gt": """SELECT s.table_name AS query_table, f.table_name AS cand_table
        FROM sides s JOIN families f USING (base) WHERE side = 'query'
        UNION SELECT table_name, base || '__RETIRED' FROM sides WHERE side = 'query'
        UNION SELECT 'lineitem__' || l_returnflag, 'lineitem__' || l_returnflag FROM lineitem
        UNION SELECT 'lineitem__' || l_returnflag, 'customer__BUILDING' FROM lineitem""",
    "value_classes": r"""SELECT *, CASE
            WHEN value IS NULL OR regexp_full_match(value, '\s*') THEN 'null'
            WHEN regexp_full_match(value, '\s*[-+]?\p{Nd}+\s*') THEN 'integer'
            WHEN regexp_full_match(value, '\s*[-+]?\p{Nd}+\.\p{Nd}+\s*') THEN 'float'
            WHEN regexp_matches(value, '\p{L}') THEN 'string'
            ELSE 'other' END AS value_class
        FROM cells""",
    "flags": r"""SELECT side, table_name, col_pos, count(*) AS n_rows, count(value) AS n_values,
            bool_and(value IS NULL OR (regexp_full_match(value, '\s*[-+]?[0-9]+\s*')
                AND try_cast(trim(value) AS BIGINT) IS NOT NULL)) AS all_int,
            bool_and(value IS NULL OR (regexp_full_match(value,
                '\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*')
                AND NOT (regexp_full_match(value, '\s*[-+]?[0-9]+\s*')
                         AND try_cast(trim(value) AS BIGINT) IS NULL))) AS all_num
        FROM cells GROUP BY ALL""",
    "stats": """SELECT m.*, coalesce(n_rows, 0) AS n_rows, coalesce(n_values, 0) AS n_values,
            all_int, all_num
        FROM meta m LEFT JOIN flags USING (side, table_name, col_pos)""",
    "voters": """SELECT side, table_name, col_pos, value_class FROM value_classes
        WHERE value IS NOT NULL""",
    "votes": """SELECT side, table_name, col_pos, CASE
            WHEN 10 * max(n) >= 7 * sum(n) THEN
                CASE WHEN arg_max(value_class, n) = 'null' THEN 'other'
                     ELSE arg_max(value_class, n) END
            WHEN bool_and(value_class IN ('integer', 'float', 'null')) THEN 'float'
            ELSE 'other' END AS vote
        FROM (SELECT side, table_name, col_pos, value_class, count(*) AS n
              FROM voters GROUP BY ALL) GROUP BY ALL""",
    "types": """SELECT s.*, CASE
            WHEN n_rows = 0 THEN 'string'
            WHEN n_values = 0 THEN 'float'
            WHEN n_values = n_rows AND all_int THEN 'integer'
            WHEN all_num THEN 'float'
            WHEN n_values = n_rows THEN 'string'
            ELSE coalesce(vote, 'other') END AS data_type
        FROM stats s LEFT JOIN votes USING (side, table_name, col_pos)""",
    "distinct_values": "SELECT DISTINCT side, table_name, col_pos, col_name, value FROM cells "
                       "WHERE value IS NOT NULL",
    "distinct_20": """SELECT *, row_number() OVER (PARTITION BY side, table_name, col_pos
            ORDER BY md5(value), value) AS rn
        FROM distinct_values QUALIFY rn <= 20""",
    "rows_20": """SELECT side, table_name, row_id, row_number() OVER (
            PARTITION BY side, table_name ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS rn
        FROM (SELECT DISTINCT side, table_name, row_id FROM cells) QUALIFY rn <= 20""",
    "encoder_texts": """SELECT m.side, m.table_name, CAST(m.col_pos AS BIGINT) AS unit_id,
            left(coalesce('Column: ' || any_value(m.col_name) || '. Values: '
                 || string_agg(value, ', ' ORDER BY rn),
                 'Column: ' || any_value(m.col_name)), 2560) AS text
        FROM meta m LEFT JOIN distinct_20 d USING (side, table_name, col_pos) GROUP BY ALL""",
    "embedding_sums": """SELECT side, table_name, unit_id, (code // 2) % 64 AS pos,
            sum(CASE WHEN code % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x
        FROM (SELECT side, table_name, unit_id,
                     ('0x' || substr(md5(word), 1, 8))::BIGINT AS code
              FROM (SELECT side, table_name, unit_id,
                           unnest(regexp_extract_all(lower(text), """ + WORD + """)) AS word
                    FROM encoder_texts))
        GROUP BY ALL""",
    "embeddings_of_texts": """SELECT side, table_name, unit_id, p.pos,
            coalesce(e.x / sqrt(sum(e.x * e.x) OVER (PARTITION BY side, table_name, unit_id)), 0)
                AS x
        FROM encoder_texts CROSS JOIN (SELECT unnest(range(64)) AS pos) p
        LEFT JOIN embedding_sums e USING (side, table_name, unit_id, pos)""",
    "encoder_vec": """SELECT side, table_name, CAST(unit_id AS INTEGER) AS col_pos, CAST(pos AS INTEGER) AS dim,
            x AS weight FROM embeddings_of_texts
        UNION ALL SELECT side, table_name, CAST(unit_id AS INTEGER), -1, 0.0 FROM encoder_texts""",
    "doc_words": """SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS pos
        FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), """ + WORD
                 + f"""), lambda w: w NOT IN ({STOP_LIST})) AS words FROM documents)""",
    "turn_words": """SELECT 'extra' AS side, conv_id, turn, unnest(words) AS token,
            generate_subscripts(words, 1) AS pos
        FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), """ + WORD
                  + f"""), lambda w: w NOT IN ({STOP_LIST})) AS words FROM conversations)""",
    "turn_terms": """SELECT conv_id, turn, token AS term FROM turn_words
        UNION ALL
        SELECT conv_id, turn, token || ' ' || following FROM (
            SELECT *, lead(token) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS following
            FROM turn_words) WHERE following IS NOT NULL""",
    "lake_terms": """SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df
        FROM term_counts WHERE side = 'lake' GROUP BY term""",
    "extra_terms": """SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df
        FROM (SELECT conv_id, turn, term, count(*) AS n FROM turn_terms GROUP BY ALL)
        GROUP BY term""",
    "terms": """SELECT term, CAST(row_number() OVER (ORDER BY tf DESC, term) - 1 AS INTEGER)
            AS term_id, tf, df,
            ln((1 + (SELECT count(*) FROM meta WHERE side = 'lake')) / (1 + df)) + 1 AS idf
        FROM lake_terms QUALIFY row_number() OVER (ORDER BY tf DESC, term) <= 4096""",
    "column_words": """SELECT side, table_name, col_pos, rn, unnest(words) AS token,
            generate_subscripts(words, 1) AS pos
        FROM (SELECT side, table_name, col_pos, rn,
                     list_filter(regexp_extract_all(lower(value), """ + WORD
                    + f"""), lambda w: w NOT IN ({STOP_LIST})) AS words FROM sample_1000)""",
    "column_terms": """SELECT side, table_name, col_pos, token AS term FROM column_words
        UNION ALL
        SELECT side, table_name, col_pos, token || ' ' || following FROM (
            SELECT *, lead(token) OVER (PARTITION BY side, table_name, col_pos ORDER BY rn, pos)
                AS following FROM column_words) WHERE following IS NOT NULL""",
    "term_counts": "SELECT side, table_name, col_pos, term, count(*) AS tf "
                   "FROM column_terms GROUP BY ALL",
    "marks": "SELECT side, table_name, col_pos, -1 AS dim, 0.0::DOUBLE AS weight FROM meta",
    "count_vec": """SELECT side, table_name, col_pos, term_id AS dim, c.tf / sqrt(sum(c.tf * c.tf)
            OVER (PARTITION BY side, table_name, col_pos)) AS weight
        FROM term_counts c JOIN terms USING (term) UNION ALL SELECT * FROM marks""",
    "tfidf_vec": """SELECT side, table_name, col_pos, term_id AS dim, c.tf * idf / sqrt(
            sum(c.tf * idf * c.tf * idf) OVER (PARTITION BY side, table_name, col_pos)) AS weight
        FROM term_counts c JOIN terms USING (term) UNION ALL SELECT * FROM marks""",
    "overlap_edges": "SELECT * FROM gt WHERE query_table <> cand_table",
    "resolved": """SELECT query_table, cand_table, (SELECT min(side) FROM sides
            WHERE table_name = cand_table) AS location
        FROM overlap_edges
        WHERE query_table IN (SELECT table_name FROM sides WHERE side = 'query')
          AND cand_table IN (SELECT table_name FROM sides)""",
    "filled_columns": "SELECT * FROM types WHERE n_values > 0",
    "typed_values": """SELECT v.*, data_type FROM distinct_values v
        JOIN filled_columns USING (side, table_name, col_pos)""",
    "value_sets": """SELECT side, table_name, data_type, 's:' || unnest(
            regexp_extract_all(lower(value), """ + WORD + """)) AS value_key
        FROM typed_values WHERE data_type = 'string'
        UNION SELECT side, table_name, data_type, 's:' || value
        FROM typed_values WHERE data_type = 'other'
        UNION SELECT side, table_name, data_type, 'n:' || CAST(value AS BIGINT)
        FROM typed_values WHERE data_type = 'integer'
        UNION SELECT side, table_name, data_type, 'n:' || CASE
            WHEN number = floor(number) THEN CAST(CAST(number AS BIGINT) AS VARCHAR)
            ELSE CAST(number AS VARCHAR) END
        FROM (SELECT *, round(CAST(value AS DOUBLE), 8) AS number FROM typed_values
              WHERE data_type = 'float')""",
    "column_names": "SELECT DISTINCT side, table_name, col_name FROM filled_columns",
    "column_pairs": """SELECT r.*,
            (SELECT count(*) FROM column_names n WHERE side = 'query' AND table_name = query_table)
                AS query_count,
            (SELECT count(*) FROM column_names n WHERE side = location AND table_name = cand_table)
                AS cand_count,
            coalesce(common, 0) AS common, coalesce(common_columns, '') AS common_columns
        FROM resolved r LEFT JOIN (
            SELECT query_table, cand_table, count(*) AS common,
                   string_agg(a.col_name, '|' ORDER BY a.col_name) AS common_columns
            FROM resolved JOIN column_names a ON a.side = 'query' AND a.table_name = query_table
            JOIN column_names b ON b.side = location AND b.table_name = cand_table
                AND a.col_name = b.col_name GROUP BY ALL) USING (query_table, cand_table)""",
    "any_values": "SELECT DISTINCT side, table_name, value_key FROM value_sets",
    "value_counts": "SELECT side, table_name, count(*) AS n FROM any_values GROUP BY ALL",
    "value_pairs": """SELECT r.*, coalesce(a.n, 0) AS query_count, coalesce(b.n, 0) AS cand_count,
            coalesce(common, 0) AS common
        FROM resolved r
        LEFT JOIN value_counts a ON a.side = 'query' AND a.table_name = query_table
        LEFT JOIN value_counts b ON b.side = location AND b.table_name = cand_table
        LEFT JOIN (SELECT query_table, cand_table, count(*) AS common FROM resolved
            JOIN any_values x ON x.side = 'query' AND x.table_name = query_table
            JOIN any_values y ON y.side = location AND y.table_name = cand_table
                AND x.value_key = y.value_key
            GROUP BY ALL) USING (query_table, cand_table)""",
    "type_counts": "SELECT side, table_name, data_type, count(*) AS n FROM value_sets GROUP BY ALL",
    "type_pairs": """SELECT r.query_table, r.cand_table, t.data_type,
            coalesce(a.n, 0) AS query_count, coalesce(b.n, 0) AS cand_count,
            coalesce(common, 0) AS common
        FROM resolved r
        CROSS JOIN (VALUES ('integer'), ('float'), ('string'), ('other')) t(data_type)
        LEFT JOIN type_counts a ON a.side = 'query' AND a.table_name = query_table
            AND a.data_type = t.data_type
        LEFT JOIN type_counts b ON b.side = location AND b.table_name = cand_table
            AND b.data_type = t.data_type
        LEFT JOIN (SELECT query_table, cand_table, x.data_type, count(*) AS common FROM resolved
            JOIN value_sets x ON x.side = 'query' AND x.table_name = query_table
            JOIN value_sets y ON y.side = location AND y.table_name = cand_table
                AND x.value_key = y.value_key AND x.data_type = y.data_type
            GROUP BY ALL) c ON c.query_table = r.query_table AND c.cand_table = r.cand_table
            AND c.data_type = t.data_type
        WHERE a.n > 0 OR b.n > 0""",
    "measures": """SELECT query_table, 'columns' AS measure, query_count, cand_count, common
        FROM column_pairs
        UNION ALL SELECT query_table, 'values', query_count, cand_count, common FROM value_pairs
        UNION ALL SELECT query_table, 'values:' || data_type, query_count, cand_count, common
        FROM type_pairs""",
    "coefficients": """SELECT *, CASE WHEN least(query_count, cand_count) > 0
            THEN common / least(query_count, cand_count) ELSE 0.0 END::DOUBLE AS v,
            CASE WHEN least(query_count, cand_count) > 0
            THEN least(9, common * 10 // least(query_count, cand_count)) ELSE 0 END AS tenth
        FROM measures""",
    "profiled": """SELECT * FROM types WHERE side = 'query' OR table_name NOT IN (
        SELECT table_name FROM sides WHERE side = 'query')""",
    "table_sizes": """SELECT side, table_name, max(n_rows) AS n_rows, count(*) AS n_columns,
            sum(n_rows - n_values) AS n_missing FROM profiled GROUP BY ALL""",
}

STATISTICS = """count(*) AS count, round(avg(v), 6) AS mean, round(median(v), 6) AS median,
    round(stddev_pop(v), 6) AS std, min(v).round(6) AS min, max(v).round(6) AS max,
    round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3,
    round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr,
    round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90"""

PAIR_RATIOS = """round(CASE WHEN least(query_count, cand_count) > 0
        THEN common / least(query_count, cand_count) ELSE 0 END, 6) AS overlap_coefficient,
    round(CASE WHEN query_count + cand_count - common > 0
        THEN common / (query_count + cand_count - common) ELSE 0 END, 6) AS jaccard"""


def _add_hash(size: int) -> str:
    """Parts for the hash vectors of a sample of the given size; returns their name."""
    PARTS[f"sample_{size}"] = f"""SELECT *, row_number() OVER (
            PARTITION BY side, table_name, col_pos ORDER BY md5(col_name || row_id), row_id) AS rn
        FROM cells WHERE value IS NOT NULL QUALIFY rn <= {size}"""
    PARTS[f"hash_counts_{size}"] = f"""SELECT side, table_name, col_pos, CAST(
            ('0x' || substr(md5(token), 1, 8))::BIGINT % 4096 AS INTEGER) AS dim, count(*) AS tf
        FROM (SELECT side, table_name, col_pos,
                     unnest(regexp_extract_all(lower(value), {WORD_2})) AS token
              FROM sample_{size}) GROUP BY ALL"""
    PARTS[f"hash_vec_{size}"] = rf"""SELECT side, table_name, col_pos, dim, tf / sqrt(sum(tf * tf)
            OVER (PARTITION BY side, table_name, col_pos)) AS weight FROM hash_counts_{size}
        UNION ALL SELECT DISTINCT side, table_name, col_pos, -1, 0.0 FROM sample_{size}
        WHERE NOT regexp_full_match(value, '\s*')"""
    return f"hash_vec_{size}"


def _pool_sql(vec: str, agg: str) -> str:
    value = {"max": "max(weight)", "sum": "sum(weight)",
             "mean": "sum(weight) / any_value(n_units)"}[agg]
    return f"""SELECT side, table_name, dim, {value} AS weight
        FROM {vec} JOIN (SELECT side, table_name, count(*) AS n_units FROM {vec} WHERE dim = -1
                         GROUP BY ALL) USING (side, table_name)
        GROUP BY side, table_name, dim"""


def _add_search(vec: str, agg: str, exclude_self: bool) -> str:
    """Parts for a pooled ranking; returns the name of the ranking."""
    key = f"{vec}_{agg}"
    PARTS[f"pool_{vec}"] = f"""SELECT table_name, max(side) AS side, min(side) AS matched_side
        FROM {vec} WHERE dim = -1 GROUP BY ALL"""
    PARTS[f"valid_{vec}"] = f"""SELECT DISTINCT query_table FROM gt
        WHERE query_table IN (SELECT table_name FROM pool_{vec})"""
    PARTS[f"tables_{key}"] = _pool_sql(vec, agg)
    PARTS[f"unit_{key}"] = f"""SELECT table_name, dim, weight / sqrt(sum(weight * weight)
            OVER (PARTITION BY table_name)) AS w
        FROM tables_{key} JOIN pool_{vec} USING (table_name, side) WHERE dim >= 0"""
    PARTS[f"cos_{key}"] = f"""SELECT a.table_name AS query_table, b.table_name AS cand_table,
            round(sum(a.w * b.w), 6) AS score
        FROM unit_{key} a JOIN unit_{key} b USING (dim)
        WHERE a.table_name IN (SELECT query_table FROM valid_{vec}) GROUP BY ALL"""
    name = f"rank_{key}_{'others' if exclude_self else 'all'}"
    PARTS[name] = f"""SELECT v.query_table, p.table_name AS cand_table,
            coalesce(c.score, 0.0) AS score, CAST(row_number() OVER (PARTITION BY v.query_table
                ORDER BY coalesce(c.score, 0.0) DESC, p.table_name) AS INTEGER) AS rank
        FROM valid_{vec} v CROSS JOIN pool_{vec} p
        LEFT JOIN cos_{key} c ON c.query_table = v.query_table AND c.cand_table = p.table_name
        {"WHERE v.query_table <> p.table_name" if exclude_self else ""} QUALIFY rank <= 10"""
    return name


def _add_matching(vec: str, exclude_self: bool) -> str:
    """Parts for a ranking by the best of all column alignments, found column by column."""
    _add_search(vec, "max", exclude_self)
    PARTS[f"edges_{vec}"] = f"""SELECT a.table_name AS query_table, a.col_pos AS query_col,
            b.table_name AS cand_table, b.col_pos AS cand_col, sum(a.weight * b.weight) AS sim
        FROM {vec} a JOIN pool_{vec} pa ON pa.table_name = a.table_name AND pa.side = a.side
        JOIN {vec} b ON b.dim = a.dim
        JOIN pool_{vec} pb ON pb.table_name = b.table_name AND pb.matched_side = b.side
        WHERE a.dim >= 0 AND a.table_name IN (SELECT query_table FROM valid_{vec})
        GROUP BY ALL HAVING sum(a.weight * b.weight) > 0.1"""
    PARTS[f"align_{vec}_0"] = f"""SELECT DISTINCT query_table, cand_table, 0 AS used,
            0.0::DOUBLE AS score FROM edges_{vec}"""
    for step in range(6):
        last = f"align_{vec}_{step}"
        PARTS[f"align_{vec}_{step + 1}"] = f"""SELECT query_table, cand_table, used,
                max(score) AS score
            FROM (SELECT * FROM {last} UNION ALL
                  SELECT s.query_table, s.cand_table, s.used | (1 << e.cand_col),
                         s.score + e.sim
                  FROM {last} s JOIN edges_{vec} e USING (query_table, cand_table)
                  WHERE e.query_col = {step} AND s.used & (1 << e.cand_col) = 0)
            GROUP BY ALL"""
    PARTS[f"match_{vec}"] = f"""SELECT query_table, cand_table, round(max(score), 6) AS score
        FROM align_{vec}_6 GROUP BY ALL"""
    name = f"rank_match_{vec}_{'others' if exclude_self else 'all'}"
    PARTS[name] = f"""SELECT v.query_table, p.table_name AS cand_table,
            coalesce(c.score, 0.0) AS score, CAST(row_number() OVER (PARTITION BY v.query_table
                ORDER BY coalesce(c.score, 0.0) DESC, p.table_name DESC) AS INTEGER) AS rank
        FROM valid_{vec} v CROSS JOIN pool_{vec} p
        LEFT JOIN match_{vec} c ON c.query_table = v.query_table AND c.cand_table = p.table_name
        {"WHERE v.query_table <> p.table_name" if exclude_self else ""} QUALIFY rank <= 10"""
    return name


def _add_metrics(ranking: str) -> str:
    """Parts for the metrics of a ranking; returns the name of the per-query metrics."""
    PARTS[f"hits_{ranking}"] = f"""SELECT r.query_table, r.cand_table, rank,
            CAST(g.cand_table IS NOT NULL AS INTEGER) AS hit,
            CAST(sum(CAST(g.cand_table IS NOT NULL AS INTEGER)) OVER (
                PARTITION BY r.query_table ORDER BY rank) AS BIGINT) AS hits
        FROM {ranking} r LEFT JOIN gt g USING (query_table, cand_table)"""
    PARTS[f"scored_{ranking}"] = f"""SELECT q.query_table, cutoff,
            (SELECT count(*) FROM gt g WHERE g.query_table = q.query_table) AS n_relevant,
            least(cutoff, q.n_ranked) AS n_seen,
            (SELECT coalesce(sum(hit), 0) FROM hits_{ranking} h
             WHERE h.query_table = q.query_table AND rank <= cutoff) AS hits,
            (SELECT coalesce(sum(hit * hits / rank), 0) FROM hits_{ranking} h
             WHERE h.query_table = q.query_table AND rank <= cutoff) AS gain
        FROM (SELECT query_table, count(*) AS n_ranked FROM {ranking} GROUP BY ALL) q
        CROSS JOIN (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS cutoff)"""
    name = f"metrics_{ranking}"
    PARTS[name] = f"""SELECT query_table, cutoff, hits / n_seen AS p, hits / n_relevant AS r,
            CASE WHEN hits > 0 THEN 2 * (hits / n_seen) * (hits / n_relevant)
                / (hits / n_seen + hits / n_relevant) ELSE 0 END AS f1,
            gain / least(cutoff, n_relevant) AS ap
        FROM scored_{ranking}"""
    return name


MEANS = """round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(f1), 6) AS f1,
    round(avg(ap), 6) AS map"""

HASH = _add_hash(1000)
HASH_5 = _add_hash(5)
RANKED = _add_search(HASH, "max", True)
RANKED_ALL = {vec: _add_search(vec, "max", False) for vec in (HASH, "count_vec", "tfidf_vec")}
MATCHED = _add_matching(HASH, False)
MATCHED_ENCODER = _add_matching("encoder_vec", False)
METRICS = _add_metrics(RANKED)


def _grid_sql() -> str:
    parts = []
    for size, vec in ((5, HASH_5), (1000, HASH)):
        rankings = {"max": _add_search(vec, "max", True), "mean": _add_search(vec, "mean", True),
                    "None": _add_matching(vec, True)}
        for agg, ranking in rankings.items():
            parts.append(f"SELECT 'hash' AS method, {size} AS sample_size, '{agg}' AS agg, cutoff, {MEANS} "
                         f"FROM {_add_metrics(ranking)} GROUP BY cutoff")
    for method, size, agg, ranking in (
            ("count", 1000, "max", _add_search("count_vec", "max", True)),
            ("tfidf", 1000, "max", _add_search("tfidf_vec", "max", True)),
            ("encoder", 20, "mean", _add_search("encoder_vec", "mean", True)),
            ("encoder", 20, "None", _add_matching("encoder_vec", True))):
        parts.append(f"SELECT '{method}' AS method, {size} AS sample_size, '{agg}' AS agg, cutoff, {MEANS} "
                     f"FROM {_add_metrics(ranking)} GROUP BY cutoff")
    return " UNION ALL ".join(parts)


def _tokens(pattern: str) -> str:
    return f"""SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id,
        unnest(regexp_extract_all(lower(text), {pattern})) AS token FROM documents) GROUP BY ALL"""


# the given tables as they are: columns in order, with the kind of their type
TYPED = {
    "customer": "c_custkey:i c_name:t c_nationkey:i c_acctbal:f c_mktsegment:t",
    "events": "event_id:i ts:d user_id:i event_type:t value:f props:t",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f "
                "l_tax:f l_returnflag:t l_linestatus:t l_shipdate:d",
    "nation": "n_nationkey:i n_name:t n_regionkey:i",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:t o_totalprice:f o_orderdate:d o_orderpriority:t",
    "part": "p_partkey:i p_name:t p_brand:t p_type:t p_size:i p_retailprice:f",
    "region": "r_regionkey:i r_name:t",
    "supplier": "s_suppkey:i s_name:t s_nationkey:i s_acctbal:f",
}
SOURCE_TYPES = {"i": "integer", "f": "float", "t": "text", "d": "text"}


def _typed_sql(types: bool) -> str:
    parts = []
    for table, columns in TYPED.items():
        for pos, (name, kind) in enumerate(column.split(":") for column in columns.split()):
            text = f"strftime({name}, '%Y-%m-%d %H:%M:%S')" if kind == "d" else name
            if types:
                no_gap = f"count({name}) = count(*)"
                data_type = {"i": f"CASE WHEN {no_gap} THEN 'integer' ELSE 'float' END", "f": "'float'"}.get(
                    kind, "'string'")
                rest = f"count({name}) AS n_values, {data_type} AS data_type"
            else:
                number = kind in "if"
                rest = f"""'{SOURCE_TYPES[kind]}' AS source_type, count(*) AS n_row_ids, count({name}) AS n_values,
                    count(DISTINCT {text}) AS n_distinct,
                    {f"round(sum(CAST({name} AS DOUBLE)), 2)" if number else "NULL::DOUBLE"} AS total,
                    {"NULL::VARCHAR" if number else f"min({text})"} AS least,
                    {"NULL::VARCHAR" if number else f"max({text})"} AS most"""
            parts.append(f"SELECT '{table}' AS table_name, {pos} AS col_pos, '{name}' AS col_name, "
                         f"count(*) AS n_rows, {rest} FROM {table}")
    return " UNION ALL ".join(parts)


UNIT = "side, table_name, col_pos"
ENCODED = """
    pooled AS (SELECT side, table_name, pos, avg(x) AS x FROM embeddings_of_texts GROUP BY ALL),
    pool AS (SELECT table_name, max(side) AS side FROM pooled GROUP BY ALL),
    unit AS (SELECT table_name, pos, x / sqrt(sum(x * x) OVER (PARTITION BY table_name)) AS x
             FROM pooled JOIN pool USING (side, table_name)),
    scores AS (SELECT a.table_name AS query_table, b.table_name AS cand_table,
                      round(sum(a.x * b.x), 6) AS score
               FROM unit a JOIN unit b USING (pos)
               WHERE a.table_name IN (SELECT query_table FROM gt) GROUP BY ALL)"""

FINAL: dict[str, str] = {
    "lake_cells": "SELECT * FROM cells",
    "parquet_lake_cells": _typed_sql(False),
    "csv_lake_cells": CSV_SQL,
    "parquet_column_types": _typed_sql(True),
    "disambiguated_headers": """SELECT side, table_name, col_pos, CASE
            WHEN name = '' THEN 'Unnamed: ' || col_pos
            WHEN nth = 1 THEN name ELSE name || '.' || (nth - 1) END AS col_name
        FROM (SELECT *, row_number() OVER (PARTITION BY side, table_name, name ORDER BY col_pos) AS nth
              FROM (SELECT side, table_name, col_pos, CASE WHEN col_pos % 3 = 1 THEN ''
                           ELSE split_part(table_name, '__', 1) END AS name FROM meta))""",
    "empty_tables": """SELECT side, table_name, CAST(col_pos AS BIGINT) AS unit_id,
            left(string_agg(value, ', ' ORDER BY rn), 2560) AS text
        FROM distinct_20 WHERE table_name NOT LIKE 'customer%' AND col_name <> 's_name'
        GROUP BY side, table_name, col_pos
        UNION ALL SELECT side, table_name, -1::BIGINT, left(string_agg(col_name, ', ' ORDER BY col_pos), 2560)
        FROM meta WHERE table_name NOT LIKE 'customer%' GROUP BY side, table_name""",
    "query_selection": """SELECT table_name, col_name, count(*) AS n FROM cells
        WHERE side = 'query' AND table_name IN (SELECT table_name FROM sides WHERE side = 'lake')
        GROUP BY ALL""",
    "ground_truth_edges": "SELECT * FROM gt",
    "value_type_histogram": f"SELECT {UNIT}, value_class, count(*) AS n FROM value_classes GROUP BY ALL",
    "column_types": f"SELECT {UNIT}, col_name, n_rows, n_values, data_type FROM types",
    "nonempty_columns": f"SELECT {UNIT}, col_name, n_values FROM stats WHERE n_values > 0",
    "column_sample": f"SELECT {UNIT}, CAST(rn AS INTEGER) AS rn, value FROM sample_1000",
    "distinct_sample": f"SELECT {UNIT}, CAST(rn AS INTEGER) AS rn, value FROM distinct_20",
    "row_sample": "SELECT side, table_name, row_id, CAST(rn AS INTEGER) AS rn FROM rows_20",
    "column_texts": f"""SELECT {UNIT}, any_value(col_name) AS col_name, any_value(col_name)
            || coalesce(' ' || string_agg(value, ' ' ORDER BY rn), '') AS text
        FROM meta LEFT JOIN sample_1000 s USING ({UNIT}, col_name) GROUP BY {UNIT}""",
    "encoder_column_texts": "SELECT * FROM encoder_texts",
    "encoder_column_texts_plain": """SELECT side, table_name, CAST(col_pos AS BIGINT) AS unit_id,
            left(string_agg(value, ', ' ORDER BY rn), 2560) AS text
        FROM (SELECT * FROM sample_1000 WHERE rn <= 20) GROUP BY side, table_name, col_pos""",
    "row_texts": r"""SELECT side, table_name, row_id AS unit_id, left(string_agg(
            col_name || ': ' || value, ', ' ORDER BY col_pos), 2560) AS text
        FROM cells JOIN rows_20 USING (side, table_name, row_id)
        WHERE regexp_matches(value, '\S') GROUP BY side, table_name, row_id""",
    "header_texts": """SELECT side, table_name, 0::BIGINT AS unit_id, left(string_agg(
            col_name, ', ' ORDER BY col_pos), 2560) AS text
        FROM meta GROUP BY side, table_name""",
    "tokens_hash": _tokens(WORD_2),
    "tokens_word": _tokens(WORD),
    "stopword_filter": "SELECT doc_id, token, count(*) AS n FROM doc_words GROUP BY ALL",
    "word_ngrams": """SELECT doc_id, term, count(*) AS n FROM (
            SELECT doc_id, token AS term FROM doc_words UNION ALL
            SELECT doc_id, token || ' ' || following FROM (SELECT *, lead(token) OVER (
                PARTITION BY doc_id ORDER BY pos) AS following FROM doc_words)
            WHERE following IS NOT NULL) GROUP BY ALL""",
    "hashing_tf": "SELECT * FROM hash_counts_1000",
    "term_counts": "SELECT * FROM term_counts",
    "vocabulary": "SELECT term, term_id, tf, df FROM terms",
    "vocabulary_extra": """SELECT term, CAST(row_number() OVER (ORDER BY tf DESC, term) - 1
            AS INTEGER) AS term_id, tf, df
        FROM (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(df) AS BIGINT) AS df
              FROM (SELECT * FROM lake_terms UNION ALL SELECT * FROM extra_terms) GROUP BY term)
        QUALIFY row_number() OVER (ORDER BY tf DESC, term) <= 4096""",
    "idf_weights": "SELECT term, df, round(idf, 6) AS idf FROM terms",
    "count_vectors": f"SELECT {UNIT}, dim, round(weight, 6) AS weight FROM count_vec",
    "tfidf_vectors": f"SELECT {UNIT}, dim, round(weight, 6) AS weight FROM tfidf_vec WHERE side = 'lake'",
    "query_vectors": f"SELECT {UNIT}, dim, round(weight, 6) AS weight FROM tfidf_vec WHERE side = 'query'",
    "unit_counts": """SELECT side, table_name, count(*) AS n_units, 'count' AS method
        FROM meta GROUP BY ALL
        UNION ALL SELECT side, table_name, count(*), 'hash' FROM hash_vec_1000
        WHERE dim = -1 GROUP BY ALL""",
    "encode_texts": """SELECT side, table_name, unit_id, CAST(pos AS INTEGER) AS pos,
            round(x, 6) AS x FROM embeddings_of_texts""",
    **{f"table_vectors_{agg}": f"SELECT side, table_name, dim, round(weight, 6) AS weight "
                               f"FROM ({_pool_sql(HASH, agg)})" for agg in ("max", "mean", "sum")},
    "dense_table_vectors": """SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS x
        FROM (SELECT label, unnest(embedding)::DOUBLE AS x,
                     generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL""",
    "cosine_pairs": f"SELECT * FROM cos_{HASH}_max",
    "dense_cosine": """WITH entries AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
                generate_subscripts(embedding, 1) AS pos FROM embeddings),
            means AS (SELECT label, pos, avg(x) AS m FROM entries GROUP BY ALL)
        SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS score
        FROM entries JOIN means USING (label, pos) GROUP BY vec_id""",
    "candidate_pool": f"""SELECT table_name, side AS searched_side, matched_side
        FROM pool_{HASH}""",
    "unionable_topk_hash": f"SELECT * FROM {RANKED_ALL[HASH]}",
    "unionable_topk_count": f"SELECT * FROM {RANKED_ALL['count_vec']}",
    "unionable_topk_tfidf": f"SELECT * FROM {RANKED_ALL['tfidf_vec']}",
    "unionable_topk_encoder": """SELECT query_table, cand_table, score, CAST(row_number() OVER (
            PARTITION BY query_table ORDER BY score DESC, cand_table) AS INTEGER) AS rank
        FROM scores QUALIFY rank <= 10""",
    "topk_excluding_self": f"SELECT * FROM {RANKED}",
    "dense_topk": """WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS name,
                embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[],
                embedding::DOUBLE[])) AS len FROM embeddings)
        SELECT a.name AS query_table, b.name AS cand_table,
               round(list_dot_product(a.e, b.e) / (a.len * b.len), 6) AS score,
               CAST(row_number() OVER (PARTITION BY a.name ORDER BY
                   round(list_dot_product(a.e, b.e) / (a.len * b.len), 6) DESC, b.name)
                   AS INTEGER) AS rank
        FROM v a JOIN v b ON a.name <> b.name QUALIFY rank <= 10""",
    "column_pair_similarity": f"""SELECT query_table, query_col, cand_table, cand_col,
        round(sim, 6) AS sim FROM edges_{HASH}""",
    "bipartite_score": f"SELECT * FROM match_{HASH}",
    "bipartite_topk": f"SELECT * FROM {MATCHED}",
    "dense_column_pairs": """SELECT query_table, query_col, cand_table, cand_col, round(sim, 6) AS sim
        FROM edges_encoder_vec""",
    "bipartite_topk_encoder": f"SELECT * FROM {MATCHED_ENCODER}",
    "valid_queries": f"""SELECT query_table, CAST(row_number() OVER (
            ORDER BY md5(query_table), query_table) <= 5 AS INTEGER) AS sampled
        FROM valid_{HASH}""",
    "gt_filtered": """SELECT * FROM gt WHERE query_table IN (
        SELECT table_name FROM sides WHERE side = 'query')""",
    "running_hits": f"SELECT * FROM hits_{RANKED}",
    "metrics_per_query": f"""SELECT query_table, cutoff, round(p, 6) AS p, round(r, 6) AS r,
        round(f1, 6) AS f1, round(ap, 6) AS ap FROM {METRICS}""",
    "metrics_at_k": f"SELECT cutoff, {MEANS} FROM {METRICS} GROUP BY cutoff",
    "ranking_detail": f"""SELECT query_table, 'candidates' AS list, rank AS position,
            cand_table AS table_name FROM {RANKED}
        UNION ALL SELECT query_table, 'ground_truth', CAST(row_number() OVER (
            PARTITION BY query_table ORDER BY cand_table) AS INTEGER), cand_table
        FROM gt WHERE query_table IN (SELECT query_table FROM {RANKED})""",
    "overlap_pairs": "SELECT * FROM overlap_edges",
    "candidate_resolution": "SELECT * FROM resolved",
    "typed_value_sets": "SELECT * FROM value_sets",
    "column_overlap": f"SELECT *, {PAIR_RATIOS} FROM column_pairs",
    "value_overlap": f"SELECT *, {PAIR_RATIOS} FROM value_pairs",
    "value_overlap_by_type": f"SELECT *, {PAIR_RATIOS} FROM type_pairs",
    "overlap_histogram": """SELECT measure, (tenth * 10) || '-' || (tenth * 10 + 10) AS bin,
            count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY measure), 6)
                AS percentage
        FROM coefficients WHERE measure IN ('columns', 'values') GROUP BY measure, tenth""",
    "overlap_histogram_by_type": """SELECT data_type, (b.tenth * 10) || '-' || (b.tenth * 10 + 10)
            AS bin, count(v) AS n, round(coalesce(100 * count(v) / nullif(sum(count(v)) OVER (
                PARTITION BY data_type), 0), 0), 6) AS percentage
        FROM (VALUES ('integer'), ('float'), ('string'), ('other')) t(data_type)
        CROSS JOIN (SELECT unnest(range(10)) AS tenth) b
        LEFT JOIN coefficients c ON c.measure = 'values:' || data_type AND c.tenth = b.tenth
        GROUP BY data_type, b.tenth""",
    "overlap_stats": f"SELECT measure, {STATISTICS} FROM coefficients GROUP BY measure",
    "overlap_by_query": f"""SELECT query_table, measure, {STATISTICS},
            (SELECT count(*) FROM gt g WHERE g.query_table = c.query_table) AS total_candidates
        FROM coefficients c GROUP BY query_table, measure""",
    "overlap_summary": """SELECT count(DISTINCT query_table) AS total_queries,
            count(*) AS total_relationships,
            round(count(*) / count(DISTINCT query_table), 6) AS avg_candidates,
            (SELECT count(DISTINCT query_table) FROM gt) AS found_queries,
            (SELECT count(*) FROM gt WHERE query_table = cand_table) AS self_pairs,
            EXISTS (SELECT * FROM gt WHERE query_table = cand_table) AS queries_as_candidates
        FROM resolved""",
    "overlap_summary_listed": """WITH listed AS (
            SELECT table_name AS query_table FROM sides WHERE side = 'lake'),
            edges AS (SELECT * FROM gt SEMI JOIN listed USING (query_table))
        SELECT count(DISTINCT query_table) AS total_queries, count(*) AS total_relationships,
            round(count(*) / count(DISTINCT query_table), 6) AS avg_candidates,
            (SELECT count(*) FROM listed) AS requested_queries,
            (SELECT count(DISTINCT query_table) FROM edges) AS found_queries,
            (SELECT count(*) FROM edges WHERE query_table = cand_table) AS self_pairs,
            EXISTS (SELECT * FROM edges WHERE query_table = cand_table) AS queries_as_candidates
        FROM resolved SEMI JOIN listed USING (query_table)""",
    "profile_dedup": f"SELECT {UNIT}, col_name, n_rows, n_values FROM profiled",
    "profile_sizes": """SELECT side, count(*) AS files, CAST(sum(n_rows) AS BIGINT) AS total_rows,
            CAST(sum(n_columns) AS BIGINT) AS total_columns,
            CAST(sum(n_rows * n_columns) AS BIGINT) AS total_cells
        FROM table_sizes GROUP BY side""",
    "profile_missing": """SELECT side, CAST(sum(n_missing) AS BIGINT) AS missing,
            round(100 * sum(n_missing) / sum(n_rows * n_columns), 2) AS missing_pct
        FROM table_sizes GROUP BY side""",
    "profile_averages": """SELECT side, CAST(round_even(avg(n_rows), 0) AS BIGINT) AS avg_rows,
            CAST(round_even(avg(n_columns), 0) AS BIGINT) AS avg_columns
        FROM table_sizes GROUP BY side""",
    "profile_column_types": """SELECT side, data_type, count(*) AS n_columns,
            round(100 * count(*) / sum(count(*)) OVER (PARTITION BY side), 2) AS pct
        FROM profiled GROUP BY side, data_type""",
    "profile_unique_columns": """SELECT side, count(DISTINCT col_name) AS unique_columns
        FROM profiled GROUP BY side
        UNION ALL SELECT 'combined', count(DISTINCT col_name) FROM profiled""",
    "profile_combined": """SELECT count(*) AS files, CAST(sum(n_rows) AS BIGINT) AS total_rows,
            CAST(sum(n_columns) AS BIGINT) AS total_columns,
            CAST(sum(n_rows * n_columns) AS BIGINT) AS total_cells,
            CAST(sum(n_missing) AS BIGINT) AS missing,
            round(100 * sum(n_missing) / sum(n_rows * n_columns), 2) AS missing_pct,
            (SELECT count(DISTINCT col_name) FROM profiled) AS unique_columns
        FROM table_sizes""",
    "prep_referenced": """SELECT side, table_name FROM sides WHERE side = 'query'
        OR table_name IN (SELECT cand_table FROM gt UNION SELECT query_table FROM gt)""",
    "prep_gt_present": "SELECT * FROM gt WHERE cand_table IN (SELECT table_name FROM sides)",
    "prep_add_self": """SELECT * FROM gt WHERE query_table <> cand_table
        UNION SELECT query_table, query_table FROM gt WHERE query_table <> cand_table""",
    "prep_truncate": """SELECT cells.* FROM cells JOIN (
            SELECT side, table_name, row_id FROM (SELECT DISTINCT side, table_name, row_id FROM cells)
            QUALIFY row_number() OVER (PARTITION BY side, table_name ORDER BY row_id) <= 1000)
        USING (side, table_name, row_id)""",
    "prep_sample_queries": """SELECT DISTINCT table_name FROM sides WHERE side = 'query'
        ORDER BY md5(table_name), table_name LIMIT 5""",
    "grid_metrics": _grid_sql(),
    "vector_store_delta": f"""SELECT 'hash' AS method, {UNIT}, dim, round(weight, 6) AS weight,
            starts_with(table_name, 'events__') OR starts_with(table_name, 'part__') AS rebuilt
        FROM hash_vec_1000
        UNION ALL SELECT 'tfidf', {UNIT}, dim, round(weight, 6), true FROM tfidf_vec""",
    "stored_runs": f"""SELECT *, 'completed' AS status FROM ({_grid_sql()})
        WHERE agg = 'max' AND sample_size = 1000""",
}

LOCAL_PARTS = {"unionable_topk_encoder": ENCODED}


def with_parts(select: str, local: str = "") -> str:
    needed: set[str] = set()
    open_texts = [select + local]
    while open_texts:
        text = open_texts.pop()
        for word in set(re.findall(r"\w+", text)) & PARTS.keys() - needed:
            needed.add(word)
            open_texts.append(PARTS[word])
    ordered: list[str] = []

    def place(name: str) -> None:
        if name in ordered:
            return
        for word in sorted(set(re.findall(r"\w+", PARTS[name])) & PARTS.keys() - {name}):
            place(word)
        ordered.append(name)

    for name in sorted(needed):
        place(name)
    parts = [f"{name} AS ({PARTS[name]})" for name in ordered]
    if local:
        parts.append(local)
    if not parts:
        return select
    if select.startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + select[len("WITH "):]
    return "WITH " + ",\n".join(parts) + "\n" + select


def oracle_sql() -> dict[str, str]:
    return {name: with_parts(select, LOCAL_PARTS.get(name, "")) for name, select in FINAL.items()}
