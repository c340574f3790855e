"""Canonical text, keys, durations."""

import json

import pytest
from pyspark.sql import functions as F

from vigil.functions.canonical import array_json, canonical_json, string_json
from vigil.functions.identity import key, key_column
from vigil.functions.scalars import duration_ms, is_blank


@pytest.mark.parametrize("value, text", [(1.0, "1"), (1e7, "10000000"), (1e21, "1e+21"), (1e-7, "1e-7"), (-0.0, "0"), (0.00015, "0.00015"), (1e20, "100000000000000000000"), (1.5, "1.5"), (-2.5e-9, "-2.5e-9")])
def test_numbers(value, text):
    assert canonical_json(value) == text


def test_keys_are_sorted_and_integers_first():
    assert canonical_json(dict.fromkeys(["10", "9", "a", "1x", "-1"], 0)) == '{"9":0,"10":0,"-1":0,"1x":0,"a":0}'


@pytest.mark.parametrize("bad", [float("nan"), object(), {1: 2}, {"a": b"x"}])
def test_non_json(bad):
    with pytest.raises((TypeError, ValueError)):
        canonical_json(bad)


def test_columns_agree_with_python(spark):
    rows = [("plain",), ('quo"te\\',), ("\x1b\x0f \x07",), ("\\u001B",), ("é\U0001f600 ",), (None,), ("",), ("null",)]
    df = spark.createDataFrame(rows, "s string").select("s", string_json(F.col("s")).alias("j"), array_json([F.lit("d"), F.col("s")]).alias("a"), key_column("event", F.col("s")).alias("k"))
    for r in df.collect():
        assert r.j == (None if r.s is None else canonical_json(r.s))
        assert r.a == canonical_json(["d", r.s]) and r.k == key("event", r.s)
        assert json.loads(r.a)[1] == r.s


@pytest.mark.parametrize("text, ms", [("1.5s", 1500), ("2m", 120_000), (7, 7), ("1d", 86_400_000)])
def test_durations(text, ms):
    assert duration_ms(text) == ms


@pytest.mark.parametrize("bad", ["2.01s", "0.27m", "", "1", 0, -1, True, "1w"])
def test_bad_durations(bad):
    with pytest.raises(ValueError):
        duration_ms(bad)


def test_blank():
    assert is_blank("﻿ ") and not is_blank("\x1c")
