"""One SQL text for Spark and for the oracle, tables read by their path and not through views."""
import re

TABLES = ("lineitem", "orders", "customer", "supplier", "part", "events", "nation", "region")
# What the two dialects write differently.
DIALECT = {
    "spark": {r"@/": "div", r"micros\((\w+)\)": r"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', \1)", r"\bWIDE\b": "decimal(38,0)", r"conv2\((\w+)\)": r"bin(\1)",
              r"sha256hex\((.*?as string\))\)": r"sha2(\1, 256)", r"\bWITHFOLD\b": "with", r"tryadd\((\w+), (\w+)\)": r"try_add(\1, \2)",
              r"trysub\((\w+), (\w+)\)": r"try_subtract(\1, \2)", r"\bEMPTY\b": "array()", r"\bfull_match\(": "regexp_like("},
    "oracle": {r"@/": "//", r"micros\((\w+)\)": r"epoch_us(\1)", r"\bWIDE\b": "hugeint", r"conv2\((\w+)\)": r"bin(\1)",
               r"sha256hex\((.*?as string\))\)": r"sha256(\1)", r"\bWITHFOLD\b": "with recursive", r"tryadd\((\w+), (\w+)\)": r"try_cast(cast(\1 as hugeint) + \2 as bigint)",
               r"trysub\((\w+), (\w+)\)": r"try_cast(cast(\1 as hugeint) - \2 as bigint)", r"\bEMPTY\b": "[]", r"\bfull_match\(": "regexp_full_match("},
}


def render(text: str, dialect: str) -> str:
    for pattern, plain in DIALECT[dialect].items():
        text = re.sub(pattern, plain, text)
    return text


def run(spark, sf_dir: str, text: str):
    """A text in Spark's dialect, its tables replaced by their files; no name of the caller's is touched."""
    path = sf_dir.replace("\\", "").replace("`", "")
    named = re.sub(rf"\b(from|join)\s+({'|'.join(TABLES)})\b(?!\s*\()", rf"\1 parquet.`{path}/\2.parquet` as \2", render(text, "spark"), flags=re.I)
    return spark.sql(named)


def queries(texts: dict) -> dict:
    """Name to query for texts that both dialects share."""
    return {name: (lambda spark, sf_dir, text=text: run(spark, sf_dir, text)) for name, text in texts.items()}


def oracles(texts: dict) -> dict:
    return {name: render(text, "oracle") for name, text in texts.items()}
