"""Scalar text functions over documents, conversations and inline fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import text as X
from quern.plans.registry import Query
from quern.session import table as t

QUERIES: list[Query] = []


def q(name, sql=None):
    def add(f):
        QUERIES.append(Query(name, f, sql))
        return f

    return add


MESSY = [("2024-01-05", "$1,000.50", " Books "), ("01/06/2024", "NA", "toys"), ("2024-02-30", "12", "TOYS "), ("bad", "x", "Garden"), (None, None, None)]
ANSWERS = [
    (1, "So the answer is (C)."), (2, "Answer: B because"), (3, "A or maybe D"), (4, "none here"), (5, r"thus \boxed{1,234} and 7"), (6, "we get 12 then 3,400.5"), (7, ""),
    (8, "```sql\nSELECT 1\n```\ntext\n```python\nprint(2)\n```"), (9, "<think>```sql\nx\n```</think>```sql\nSELECT 3\n```"),
]


def values(rows, names):
    """An inline table in DuckDB."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) AS v({names})"


@q("f6_mixed_dates", f"SELECT d, coalesce(try_strptime(d,'%Y-%m-%d'), try_strptime(d,'%m/%d/%Y'))::DATE::VARCHAR AS day FROM {values(MESSY, 'd, a, c')}")
def _(s, d):
    return s.createDataFrame(MESSY, "d string, a string, c string").select("d", X.mixed_date(F.col("d")).cast("string").alias("day"))


@q("f7_money", f"SELECT a, try_cast(nullif(regexp_replace(trim(a),'[$,]','','g'),'NA') AS DOUBLE) AS amount FROM {values(MESSY, 'd, a, c')}")
def _(s, d):
    return s.createDataFrame(MESSY, "d string, a string, c string").select("a", X.money(F.col("a")).alias("amount"))


@q("f15_tokens", "SELECT doc_id, len(regexp_extract_all(lower(text),'[a-z0-9]+'))::BIGINT AS n, md5(array_to_string(regexp_extract_all(lower(text),'[a-z0-9]+'),' ')) AS digest FROM documents")
def _(s, d):
    w = X.tokens(F.col("text"))
    return t(s, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


@q("f16_ngrams", "WITH w AS (SELECT item_id, regexp_extract_all(lower(text),'[a-z0-9]+') AS w FROM benchmark) SELECT DISTINCT item_id, array_to_string(w[i:i+12],' ') AS gram FROM (SELECT item_id, w, unnest(range(1,len(w)-11)) AS i FROM w WHERE len(w)>=13)")
def _(s, d):
    return X.item_grams(t(s, d, "benchmark"), "item_id").select("item_id", "gram")


@q("f17_approx_tokens", "SELECT conv_id, round_even(sum(length(text))/3.5,0)::BIGINT AS n FROM conversations GROUP BY 1")
def _(s, d):
    return t(s, d, "conversations").groupBy("conv_id").agg(X.approx_tokens(F.sum(F.length("text"))).alias("n"))


@q("f18_code_blocks", None)
def _(s, d):
    x = s.createDataFrame(ANSWERS, "id int, text string")
    return x.select("id", F.try_element_at(X.code_blocks(F.col("text")), F.lit(-1)).alias("last"), F.try_element_at(X.code_blocks(F.col("text"), "sql"), F.lit(1)).alias("sql"))


@q("f19_answer_letter", f"""SELECT id, coalesce(nullif(regexp_extract(text,'(?i:answer is) \\(?([A-J])\\)?',1),''), nullif(regexp_extract(text,'(?s).*(?i:answer:)\\s*([A-J])',1),''), list_last(regexp_extract_all(text,'\\b([A-J])\\b',1))) AS letter FROM {values(ANSWERS, 'id, text')}""")
def _(s, d):
    return s.createDataFrame(ANSWERS, "id int, text string").select("id", X.answer_letter(F.col("text")).alias("letter"))


@q("f20_final_number", f"""SELECT id, try_cast(replace(coalesce(list_last(regexp_extract_all(text,'\\\\boxed\\{{(-?[0-9][0-9,]*\\.?[0-9]*)\\}}',1)), list_last(regexp_extract_all(text,'(-?[0-9][0-9,]*\\.?[0-9]*)',1))),',','') AS DOUBLE) AS number FROM {values(ANSWERS, 'id, text')}""")
def _(s, d):
    return s.createDataFrame(ANSWERS, "id int, text string").select("id", X.last_number(F.col("text")).alias("number"))


@q("f21_balanced_json", None)
def _(s, d):
    from quern.functions.extract import first_json

    rows = [(1, 'x {"a": {"b": "}"}} y'), (2, "no json"), (3, '{"open": 1'), (4, '{"a":"\\"}"} tail {}')]
    return s.createDataFrame(rows, "id int, text string").select("id", first_json(F.col("text")).alias("json"))


@q("f22_coercion", f"SELECT v, try_cast(v AS DOUBLE) AS number, (CASE WHEN lower(v) IN ('true','yes') THEN true WHEN lower(v) IN ('false','no') THEN false END)::VARCHAR AS flag FROM {values([('5',), ('5.0',), ('Yes',), ('false',), ('junk',), (None,)], 'v')}")
def _(s, d):
    from quern.functions.extract import as_flag, as_number

    x = s.createDataFrame([("5",), ("5.0",), ("Yes",), ("false",), ("junk",), (None,)], "v string")
    return x.select("v", as_number(F.col("v")).alias("number"), as_flag(F.col("v")).cast("string").alias("flag"))


@q("f23_class_match", f"SELECT v, CASE WHEN lower(v)='runway' THEN 'runway' WHEN lower(v)='taxiway' THEN 'taxiway' WHEN lower(v)='airspace' THEN 'airspace' WHEN contains(lower(v),'runway') THEN 'runway' WHEN contains(lower(v),'taxiway') THEN 'taxiway' WHEN contains(lower(v),'airspace') THEN 'airspace' END AS class FROM {values([('Runway',), ('the taxiway and runway',), ('airspace class',), ('other',)], 'v')}")
def _(s, d):
    from quern.functions.extract import class_match

    x = s.createDataFrame([("Runway",), ("the taxiway and runway",), ("airspace class",), ("other",)], "v string")
    return x.select("v", class_match(F.col("v"), ["runway", "taxiway", "airspace"]).alias("class"))


@q("f24_tool_calls", None)
def _(s, d):
    from quern.operators.chat import normalised_calls

    rows = [(1, 1, "call", "add", {"a": "1"}), (1, 2, "call", "sub", {"b": "2"}), (1, 3, "response", "add", None), (1, 4, "response", "sub", None)]
    return normalised_calls(s.createDataFrame(rows, "conv_id int, seq int, kind string, name string, arguments map<string,string>"))


@q("f25_worked_answer", f"SELECT regexp_replace(v,'<<[^>]*>>','','g') AS bare, trim(regexp_extract(v,'####\\s*(.*)$',1)) AS final FROM {values([('2+3=<<2+3=5>>5 #### 5',), ('none',)], 'v')}")
def _(s, d):
    x = s.createDataFrame([("2+3=<<2+3=5>>5 #### 5",), ("none",)], "v string")
    return x.select(F.regexp_replace("v", "<<[^>]*>>", "").alias("bare"), F.trim(F.regexp_extract("v", r"####\s*(.*)$", 1)).alias("final"))


@q("f26_standardise", "SELECT p_partkey, replace(lower(regexp_replace(p_name,'[ ,./_*^-]','','g')),'\"','''') AS name FROM part")
def _(s, d):
    return t(s, d, "part").select("p_partkey", X.standardised(F.col("p_name")).alias("name"))


@q("f27_typed_equality", f"""SELECT id, CASE kind WHEN 'number' THEN coalesce(abs(try_cast(a AS DOUBLE)-try_cast(b AS DOUBLE)) < 1e-9,false) WHEN 'string' THEN lower(replace(a,' ',''))=lower(replace(b,' ','')) WHEN 'array' THEN list_sort(list_distinct(string_split(a,',')))=list_sort(list_distinct(string_split(b,','))) ELSE a=b END AS equal
   FROM {values([(1, 'number', '5', '5.0'), (2, 'string', 'New York', 'newyork'), (3, 'array', 'a,b', 'b,a,a'), (4, 'bool', 'true', 'false')], 'id, kind, a, b')}""")
def _(s, d):
    from quern.functions.extract import typed_equal

    x = s.createDataFrame([(1, "number", "5", "5.0"), (2, "string", "New York", "newyork"), (3, "array", "a,b", "b,a,a"), (4, "bool", "true", "false")], "id int, kind string, a string, b string")
    return x.select("id", typed_equal(F.col("kind"), F.col("a"), F.col("b")).alias("equal"))


@q("f28_json_keys", "SELECT event_id, json_valid(props) AS valid, list_sort(json_keys(props)) AS keys FROM events")
def _(s, d):
    return t(s, d, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"), F.sort_array(F.json_object_keys("props")).alias("keys"))


@q("f29_ordered_rules", "SELECT doc_id, CASE WHEN contains(text,'***') THEN 'junk' WHEN contains(text,'!!') THEN 'shout' WHEN contains(text,' | ') THEN 'table' ELSE 'prose' END AS kind FROM documents")
def _(s, d):
    from quern.functions.extract import first_rule

    return t(s, d, "documents").select("doc_id", first_rule(F.col("text"), [("***", "junk"), ("!!", "shout"), (" | ", "table")], "prose").alias("kind"))


@q("f30_embedded_input", f"SELECT v, regexp_extract(v,'(?s)INPUT: (.*?)\n\nJSON:',1) AS input FROM {values([('x INPUT: METAR A' + chr(10) + chr(10) + 'JSON:',), ('none',)], 'v')}")
def _(s, d):
    x = s.createDataFrame([("x INPUT: METAR A\n\nJSON:",), ("none",)], "v string")
    return x.select("v", F.regexp_extract("v", r"(?s)INPUT: (.*?)\n\nJSON:", 1).alias("input"))


@q("f31_key_remap", None)
def _(s, d):
    from quern.functions.extract import remapped

    x = s.createDataFrame([(1, {"Rwy": " 09 ", "State": "closed"}), (2, {"Twy": "", "State": "OPEN"})], "id int, m map<string,string>")
    return x.select("id", remapped(F.col("m"), {"Rwy": "runway", "Twy": "taxiway", "State": "status"}, {"closed": "CLSD", "OPEN": "OPN"}).alias("m"))


@q("f32_sentence_scan", "SELECT conv_id, turn, len(list_filter(regexp_extract_all(text,'[^.!?]+[.!?]'), lambda x: contains(lower(x),'the')))::BIGINT AS n FROM conversations")
def _(s, d):
    hits = F.filter(F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]"), 0), lambda x: F.contains(F.lower(x), F.lit("the")))
    return t(s, d, "conversations").select("conv_id", "turn", F.size(hits).cast("long").alias("n"))


@q("f33_cut_position", "SELECT conv_id, turn, coalesce(nullif(instr(text, chr(10)),0), length(text)+1)::INTEGER AS cut FROM conversations")
def _(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", F.coalesce(F.nullif(F.regexp_instr("text", F.lit("\n")), F.lit(0)), F.length("text") + 1).alias("cut"))


@q("f34_last_query", "SELECT conv_id, coalesce(max(turn) FILTER (WHERE role='user' AND NOT starts_with(text,'<tool_response>')),-1)::INTEGER AS last_query FROM conversations GROUP BY 1")
def _(s, d):
    from quern.operators.chat import last_query_index

    m = t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return m.select("conv_id", last_query_index(F.col("m")).alias("last_query"))


@q("f35_error_text", f"SELECT v, regexp_matches(v,'^(ERROR|Error)|Traceback|SyntaxError') AS is_error FROM {values([('ERROR: x',), ('fine',), ('a Traceback b',)], 'v')}")
def _(s, d):
    return s.createDataFrame([("ERROR: x",), ("fine",), ("a Traceback b",)], "v string").select("v", F.col("v").rlike("^(ERROR|Error)|Traceback|SyntaxError").alias("is_error"))


@q("f36_number_wording", f"SELECT v, try_cast(regexp_extract(v,'(-?[0-9]+\\.?[0-9]*)',1) AS DOUBLE) AS first_number FROM {values([('about 12.5 minutes',), ('none',)], 'v')}")
def _(s, d):
    return s.createDataFrame([("about 12.5 minutes",), ("none",)], "v string").select("v", F.regexp_extract("v", r"(-?[0-9]+\.?[0-9]*)", 1).try_cast("double").alias("first_number"))
