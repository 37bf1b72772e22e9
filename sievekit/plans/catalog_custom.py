"""Registered queries for user-defined detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators import custom as C
from sievekit.operators import user_examples
from sievekit.operators.codescan import code_safety_scan
from sievekit.operators.wordlist import find_words
from sievekit.plans.detect import detect
from sievekit.schema import posexploded
from sievekit.sources.tables import table

FLAT = ["doc_id", "ord", "start", "end", "text", "detection", "detection_type", "score"]


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def python_registry() -> C.CustomRegistry:
    return C.CustomRegistry().from_module(user_examples, native=False)


def _flat(df, params, registry=None, headers_col=None, on_error="failfast"):
    return detect(df, params, output="flat", on_error=on_error, registry=registry, headers_col=headers_col).select(*FLAT)


def _whole_text_sql(name: str, where: str, det: str | None = None, typ: str | None = None) -> str:
    det = det or name
    typ = typ or name
    return f"""SELECT doc_id, 0 AS ord, 0 AS "start", CAST(length(text) AS INT) AS "end", text, '{det}' AS detection,
       '{typ}' AS detection_type, CAST(1.0 AS DOUBLE) AS score FROM documents WHERE {where}"""


def custom_bool_q(spark, sf_dir):
    """A Python ``f(text) -> bool`` (Arrow-batched UDF path)."""
    return _flat(_docs(spark, sf_dir), {"custom": ["over_100_characters"]}, python_registry())


def custom_dict_q(spark, sf_dir):
    """A Python ``f(text) -> dict`` parsed into one detection; falsy means none."""
    return _flat(_docs(spark, sf_dir), {"custom": ["contains_the"]}, python_registry())


CUSTOM_DICT_SQL = """SELECT doc_id, 0 AS ord, CAST(strpos(lower(text), 'the') - 1 AS INT) AS "start", CAST(strpos(lower(text), 'the') + 2 AS INT) AS "end",
       text, 'word: the' AS detection, 'content_check' AS detection_type, CAST(1.0 AS DOUBLE) AS score
FROM documents WHERE strpos(lower(text), 'the') > 0"""


def over_100_characters_q(spark, sf_dir):
    """The same rule as a native Column builder."""
    return _flat(_docs(spark, sf_dir), {"custom": ["over_100_characters"]})


def _word_list(spark, sf_dir):
    """Words to look for: those of the benchmark passages, customers' names, and the example's word."""
    passages = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("word"))
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("word"))
    return passages.unionByName(names).unionByName(spark.sql(f"SELECT '{C.FORBIDDEN_WORD}' AS word"))


def contains_word_q(spark, sf_dir):
    """U4: the first place of every listed word in documents and conversation turns."""
    conv = table(spark, sf_dir, "conversations").select((-(F.col("conv_id") * 1000 + F.col("turn")) - 1).alias("doc_id"), "text")
    found = find_words(_docs(spark, sf_dir).unionByName(conv), _word_list(spark, sf_dir))
    return found.select("doc_id", "word", "start", "end", "detection", "detection_type", "score")


CONTAINS_WORD_SQL = """WITH s AS (SELECT doc_id, lower(text) AS t FROM documents UNION ALL SELECT -(conv_id * 1000 + turn) - 1, lower(text) FROM conversations),
w AS (SELECT DISTINCT lower(word) AS word FROM (
  SELECT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS word FROM benchmark UNION ALL SELECT c_name FROM customer UNION ALL SELECT 'apple'))
SELECT doc_id, word, CAST(strpos(t, word) - 1 AS INT) AS "start", CAST(strpos(t, word) - 1 + length(word) AS INT) AS "end",
       'forbidden_word: ' || word AS detection, 'content_check' AS detection_type, CAST(1.0 AS DOUBLE) AS score
FROM s JOIN w ON contains(t, word)"""


def custom_with_headers_q(spark, sf_dir):
    """Per-row request headers reach the detector as a map column."""
    df = _docs(spark, sf_dir).withColumn("headers", F.create_map(F.lit("magic-key"), (F.col("doc_id") % 250).cast("string")))
    return _flat(df, {"custom": ["function_that_needs_headers"]}, headers_col="headers").select(*FLAT)


def custom_with_kwargs_q(spark, sf_dir):
    """Dict-form params give per-function kwargs (Python path)."""
    return _flat(_docs(spark, sf_dir), {"custom": {"function_that_needs_kwargs": {"magic-key": "456"}}}, python_registry())


def custom_registry_q(spark, sf_dir):
    """Every public function of a user module is a detector; errors quarantined per row."""
    reg = python_registry()
    df = _docs(spark, sf_dir).withColumn("headers", F.create_map(F.lit("magic-key"), F.lit("777")))
    names = [n for n in reg.names() if n != "function_that_needs_kwargs"]
    d = detect(df, {"custom": names}, registry=reg, headers_col="headers", on_error="quarantine")
    flat = posexploded(d, ["doc_id", F.size("errors").alias("n_errors")], F.col("detections"), "x")
    return flat.select("doc_id", "n_errors", "ord", F.col("x.detection").alias("detection"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))


CUSTOM_REGISTRY_SQL = """WITH d AS (SELECT doc_id, text, CASE WHEN text LIKE '%e' THEN 1 ELSE 0 END AS n_errors FROM documents),
f AS (
  SELECT doc_id, n_errors, 'contains_the' AS fn, 'word: the' AS detection, strpos(lower(text), 'the') - 1 AS "start", strpos(lower(text), 'the') + 2 AS "end" FROM d WHERE contains(lower(text), 'the')
  UNION ALL SELECT doc_id, n_errors, 'contains_word', 'forbidden_word: apple', strpos(lower(text), 'apple') - 1, strpos(lower(text), 'apple') + 4 FROM d WHERE contains(lower(text), 'apple')
  UNION ALL SELECT doc_id, n_errors, 'function_that_needs_headers', 'function_that_needs_headers', 0, length(text) FROM d
  UNION ALL SELECT doc_id, n_errors, 'over_100_characters', 'over_100_characters', 0, length(text) FROM d WHERE length(text) > 100
  UNION ALL SELECT doc_id, n_errors, 'throws_error', 'throws_error', 0, length(text) FROM d WHERE text LIKE '%a')
SELECT doc_id, CAST(n_errors AS INT) AS n_errors, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY fn) - 1 AS INT) AS ord, detection,
       CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end" FROM f"""


# Shapes of module code, chosen by doc_id: (source, findings as (line within it, rule, name)).
CODE_SHAPES = [
    ("x = 1; import os", [(1, "import", "os")]),
    ("if x: import json, \\\n  subprocess", [(1, "import", "subprocess")]),
    ("s = \"\"\"\nimport os\neval(1)\n\"\"\"\nexec(s)", [(5, "call", "exec")]),
    ("def open(x): return x", []),
    ("class A:\n    def eval(self):\n        return self.eval(1)", []),
    ("from os import environ as e", []),
    ("from os import (\n    environ,\n    path)", [(1, "import", "os")]),
    ("import os.path as p, sys # shutil", [(1, "import", "os.path"), (1, "import", "sys")]),
    ("y = f\"{eval(x)} {{exec(x)}}\"", [(1, "call", "eval")]),
    ("z = [open(\n  'a'), compile\n  ('b', '', 'exec')]", [(1, "call", "open"), (2, "call", "compile")]),
    ("def broken(:", None),
]


def code_safety_scan_q(spark, sf_dir):
    """U8: a Python module per document: its text as literals of two kinds, a shape of code before and after."""
    shapes = F.array(*[F.lit(source) for source, _ in CODE_SHAPES])
    shape = F.element_at(shapes, (F.pmod("doc_id", F.lit(len(CODE_SHAPES))) + 1).cast("int"))
    inner = F.regexp_replace("text", r"[\"\\\\\x00]", "")
    src = F.concat(F.lit("x = "), F.to_json(F.array("text")), F.lit("\n"), shape, F.lit('\ny = """'), inner, F.lit('"""\neval(y)\n'))
    docs = _docs(spark, sf_dir)
    return code_safety_scan(docs.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), src.alias("source")))


def _code_safety_sql() -> str:
    """Findings by shape; ``lines`` places the call after the shape and the quoted text."""
    n, rows = len(CODE_SHAPES), []
    for k, (source, found) in enumerate(CODE_SHAPES):
        if found is None:
            rows.append(f"SELECT path, NULL::INT AS line, 'syntax' AS rule, NULL AS name FROM d WHERE k = {k}")
            continue
        rows += [f"SELECT path, {1 + line}::INT AS line, '{rule}' AS rule, '{name}' AS name FROM d WHERE k = {k}" for line, rule, name in found]
        rows.append(f"SELECT path, ({4 + source.count(chr(10))} + breaks)::INT AS line, 'call' AS rule, 'eval' AS name FROM d WHERE k = {k}")
    breaks = "length(text) - length(replace(text, chr(10), ''))"
    return f"""WITH d AS (SELECT 'doc_' || doc_id || '.py' AS path, doc_id % {n} AS k, {breaks} AS breaks FROM documents)
""" + "\nUNION ALL ".join(rows)


def user_metrics_q(spark, sf_dir):
    """Counters attached to detectors, computed as named aggregates in the same scan."""
    conv = table(spark, sf_dir, "conversations").select("text")
    reg = C.example_registry()
    reg.register("multiline_counter", lambda t: F.lit(False), metrics={"multiline": lambda t: t.contains("\n")})
    return C.user_metrics(conv, reg, ["has_metrics", "background_function", "multiline_counter"])


USER_METRICS_SQL = """SELECT count(*) FILTER (WHERE contains(text, 'sorry')) AS system_prompt_rejections,
       count(*) FILTER (WHERE contains(text, 'sorry')) AS background_metric,
       count(*) FILTER (WHERE contains(text, chr(10))) AS multiline FROM conversations"""


def side_output_q(spark, sf_dir):
    """A non-blocking detector never changes the main result; its findings are a second table."""
    conv = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("content_id"), "text")
    reg = C.example_registry()
    reg.register("background_multiline", lambda t: t.contains("\n"), non_blocking=False)
    side = C.side_output(conv, reg, ["background_function", "background_multiline"], ["content_id"])
    return side.select("content_id", "detector_name", F.col("detection.detection").alias("detection"), F.col("detection.end").alias("end"))


SIDE_OUTPUT_SQL = """SELECT conv_id * 1000 + turn AS content_id, 'background_function' AS detector_name, 'background_function' AS detection,
       CAST(length(text) AS INT) AS "end" FROM conversations WHERE contains(text, 'sorry')
UNION ALL
SELECT conv_id * 1000 + turn, 'background_multiline', 'background_multiline', CAST(length(text) AS INT) FROM conversations WHERE contains(text, chr(10))"""


def build() -> dict:
    return {
        "custom_bool": (custom_bool_q, _whole_text_sql("over_100_characters", "length(text) > 100")),
        "custom_dict": (custom_dict_q, CUSTOM_DICT_SQL),
        "over_100_characters": (over_100_characters_q, _whole_text_sql("over_100_characters", "length(text) > 100")),
        "contains_word": (contains_word_q, CONTAINS_WORD_SQL),
        "custom_with_headers": (custom_with_headers_q, _whole_text_sql("function_that_needs_headers", "CAST(doc_id % 250 AS VARCHAR) <> '123'")),
        "custom_with_kwargs": (custom_with_kwargs_q, _whole_text_sql("function_that_needs_kwargs", "TRUE")),
        "custom_registry": (custom_registry_q, CUSTOM_REGISTRY_SQL),
        "code_safety_scan": (code_safety_scan_q, _code_safety_sql()),
        "user_metrics": (user_metrics_q, USER_METRICS_SQL),
        "side_output": (side_output_q, SIDE_OUTPUT_SQL),
    }
