"""Plug-ins for models: embedding and text completion. Defaults need no model."""

from __future__ import annotations

import re
import time
import zlib

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 64


def hashed_encoder():
    """Default encoder: (dense, sparse) from word frequencies; words hash to dimensions and tokens."""

    def encode(texts: list[str]):
        out = []
        for text in texts:
            ids, n = np.unique([zlib.crc32(w.encode()) & 0x7FFFFFFF for w in re.findall(r"\w+", (text or "").lower())] or [0], return_counts=True)
            dense = np.zeros(DIM)
            np.add.at(dense, ids % DIM, n)
            out.append((dense / np.linalg.norm(dense), dict(zip(ids.tolist(), (n / n.sum()).tolist(), strict=True))))
        return out

    return encode


def embed(df: DataFrame, text: str, encoder=hashed_encoder, batch: int = 64) -> DataFrame:
    """``df`` with dense array<float> and sparse map<int,float>; ``encoder`` is built once per worker and gets ``batch`` texts at a time."""
    schema = T.StructType([*df.schema.fields, T.StructField("dense", T.ArrayType(T.FloatType())), T.StructField("sparse", T.MapType(T.IntegerType(), T.FloatType()))])

    def run(batches):
        encode = encoder()
        for pdf in batches:
            texts = pdf[text].tolist()
            done = [x for a in range(0, len(texts), batch) for x in encode(texts[a : a + batch])]
            yield pdf.assign(dense=[np.asarray(d, np.float32) for d, _ in done], sparse=[s for _, s in done])

    return df.mapInPandas(run, schema)


def complete(df: DataFrame, prompt: str, client, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """``df`` with ``response``: the client's text for each prompt, blank if every try fails; waits 0.5, 1, 2 ... seconds between tries.

    ``client``: a function without arguments that returns f(prompt) -> str. Write the result before using it, so that calls aren't repeated."""
    def run(batches):
        ask = client()

        def one(text):
            for n in range(tries):
                try:
                    return ask(text) or ""
                except Exception:
                    if n + 1 < tries:
                        time.sleep(wait * 2**n)
            return ""

        for pdf in batches:
            yield pdf.assign(response=pd.Series([one(t) for t in pdf[prompt]], index=pdf.index, dtype=object))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("response", T.StringType())]))


def complete_once(df: DataFrame, prompt: str, client, answers: str, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """As ``complete``, but answers are kept in the table ``answers`` by a digest of their prompt: each distinct prompt is asked once, also over several runs.

    The calls are made now, and their answers written, before the result is returned. Blank answers, of tries that failed, aren't kept and are asked for again
    by the next run. A null prompt is the blank one."""
    spark = df.sparkSession
    keyed = df.withColumn("_prompt", F.coalesce(F.col(prompt), F.lit(""))).withColumn("_key", F.sha2("_prompt", 256))
    asked = keyed.select("_key", "_prompt").dropDuplicates(["_key"])
    try:
        asked = asked.join(spark.read.parquet(answers).select("_key"), "_key", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    complete(asked, "_prompt", client, tries, wait).where("response <> ''").select("_key", "response").write.mode("append").parquet(answers)
    known = spark.read.schema("_key string, response string").parquet(answers).groupBy("_key").agg(F.min("response").alias("response"))
    return keyed.join(known, "_key", "left").drop("_key", "_prompt").withColumn("response", F.coalesce("response", F.lit("")))
