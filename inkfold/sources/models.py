"""Model calls (text recognition, field extraction) behind an interface: any function of a batch of rows.

No recogniser, language model or image library is part of this package. `recognise` and `extract` run what the caller gives;
the stand-ins below are deterministic, so that pipelines and tests run without a model.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled, string_or_empty
from ..schema import EXTRACTED

Model = Callable[[list], list]


def apply_model(df: DataFrame, column: str, out: str, load: Callable[[], Model], kind: str = "string") -> DataFrame:
    """df with `out`: the model's answer (of any Spark type: text, bytes, struct) for each value of `column`. The model is loaded
    once for each Python worker and is called with a batch of values; where that fails, with each alone: a row on which it
    fails has a null and its error in <out>_error."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` {kind}, `{out}_error` string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            values = frame[column].tolist()
            try:
                answers, errors = list(model(values)), [None] * len(values)
                if len(answers) != len(values):
                    raise ValueError("a model answers each value once")
            except Exception:  # noqa: BLE001
                answers, errors = [], []
                for value in values:  # some row fails: find which
                    try:
                        answers.append(model([value])[0])
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        answers.append(None)
                        errors.append(str(e)[:2000])
            yield frame.assign(**{out: answers, f"{out}_error": errors})

    return df.mapInPandas(run, schema)


def text_passthrough() -> Model:
    """Stand-in recogniser: the bytes' own text, a block for each line."""
    return lambda xs: [json.dumps([{"text": t, "box": [0, 20 * i, 10 * len(t), 20 * i + 16]} for i, t in enumerate(bytes(x).decode("utf-8", "replace").splitlines()) if t.strip()], ensure_ascii=False) for x in xs]


def mail_and_phone() -> Model:
    """Stand-in extractor: a JSON object with the e-mail address and telephone number of a text."""
    find = lambda p, t: (re.findall(p, t or "") or [""])[0]
    return lambda xs: [json.dumps({"email": find(r"[\w.+-]+@[\w.-]+", x), "tel": find(r"\+?\d[\d() -]{7,}\d", x)}) for x in xs]


def json_object(answer: Column) -> Column:
    """VARIANT of the JSON object in a model's answer: without a code fence, else from the first brace to the last; null
    where there is none."""
    bare = F.regexp_replace(F.trim(answer), r"(?s)^```[A-Za-z]*\s*|\s*```$", "")
    whole = F.try_parse_json(bare)
    inner = F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_object(whole), whole).when(is_object(inner), inner)


def fields(answer: Column) -> dict[str, Column]:
    """The twelve extracted fields as text, empty where missing, the whole object under `raw`, and whether it failed."""
    v = json_object(answer)
    return {f: F.when(v.isNull(), "").otherwise(string_or_empty(F.try_variant_get(v, f"$.{f}", "variant"))) for f in EXTRACTED} | {"raw": F.to_json(v), "failed": v.isNull()}


# Other names under which the fields may come.
ALIASES = {"person_name": "name", "company_name": "company", "title": "position", "tel": "phone", "website": "url"}


def with_aliases(df: DataFrame) -> DataFrame:
    """Fields that are empty, filled from their alias columns where there are such."""
    return df.select(*[first_filled(F.col(c), F.col(ALIASES[c]), "").alias(c) if c in ALIASES and ALIASES[c] in df.columns else F.col(c) for c in df.columns])


def prompt(text: Column) -> Column:
    """Instruction and text for an extractor."""
    return F.concat(F.lit(f"Answer with one JSON object that has the keys {', '.join(EXTRACTED)}; leave unknown ones empty. Text:\n"), F.coalesce(text, F.lit("")))
