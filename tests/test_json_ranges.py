"""One JSON file read by byte ranges equals the whole-file reader, and a file written at offsets is the object meant."""

import io
import json
import random

import pytest
from pyspark.errors import PythonException

from parlance.operators import dialogue as D
from parlance.sources import json_ranges as J
from parlance.sources import readers as R


def nasty(rng, n):
    """Texts with quotes, brackets, commas, runs of backslashes and characters of several bytes."""
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "a", " ", "é", "\n", "😀"]) for _ in range(n))


def value_of(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 2:
        return nasty(rng, rng.randrange(12))
    if kind == 2:
        return rng.choice([None, True, 1.5, -3])
    if kind == 3:
        return [value_of(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {nasty(rng, 4) + str(i): value_of(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_marks_compose_over_any_cut(size):
    rng = random.Random(size)
    data = json.dumps([value_of(rng) for _ in range(30)], ensure_ascii=False).encode()
    whole, kinds, inside, pending = J.marks(data, 0, 0)
    at, state = [], (0, 0)
    for i in range(0, len(data), size):
        places, _, *state = J.marks(data[i:i + size], *state)
        at += [i + p for p in places.tolist()]
    assert at == whole.tolist() and (inside, pending) == (0, 0) == tuple(state)


@pytest.mark.parametrize("indent", [None, 1])
def test_cut_gives_every_element_once(indent):
    rng = random.Random(5)
    values = [value_of(rng) for _ in range(25)]
    data = json.dumps(values, ensure_ascii=False, indent=indent).encode()
    for span in (1, 5, 33, 1000, 10 ** 6):
        got = []
        for start in range(0, len(data), span):
            inside, pending, depth = 0, 0, 0
            if start:
                _, kinds, inside, pending = J.marks(data[:start], 0, 0)
                depth = int(J._steps(kinds).sum())
            state = J.STARTS.index((inside, pending if inside else 0))
            got += [json.loads(raw) for _, element, raw, _ in
                    J.cut(io.BytesIO(data), start, min(len(data), start + span), state, depth, 1, 11) if element]
        assert got == values


@pytest.mark.parametrize("indent", [None, 2])
def test_indented_file_is_read_by_several_tasks(spark, tmp_path, indent):
    rng = random.Random(1)
    logs = {f"D{i}": {"log": [{"text": nasty(rng, 40), "metadata": {}} for _ in range(rng.randrange(5))]} for i in range(60)}
    path = tmp_path / "logs.json"
    path.write_text(json.dumps(logs, indent=indent))
    rows = J.read_json_elements(spark, str(path), range_bytes=700, chunk_bytes=256)
    assert rows.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).filter(lambda n: n > 0).count() > 3
    got = sorted(rows.collect(), key=lambda r: r["at"])
    assert [(r["key"], json.loads(r["value"])) for r in got] == list(logs.items())
    split = D.explode_dialogues(R.read_keyed_logs_by_range(spark, str(path), range_bytes=700))
    whole = D.explode_dialogues(R.read_keyed_logs(spark, str(path), whole_files=True))
    cols = ["dialog_id", "utt_idx", "text", "is_sys"]
    assert sorted(map(tuple, split.select(cols).collect())) == sorted(map(tuple, whole.select(cols).collect()))


def test_arrays_levels_and_odd_files(spark, tmp_path):
    for name, text in {"a": '﻿ [1, "x:y", [2], {"k": 1}] ', "b": "", "c": "[]", "d": '{"a": 1}\n{"b": []}', "e": " { } "}.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    rows = J.read_json_elements(spark, str(tmp_path), range_bytes=3, chunk_bytes=2).collect()
    by_file = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["at"])):
        by_file.setdefault(r["path"][-6], []).append((r["key"], r["value"]))
    assert by_file == {"a": [(None, "1"), (None, '"x:y"'), (None, "[2]"), (None, '{"k": 1}')], "d": [("a", "1"), ("b", "[]")]}
    nested = {"p": [1, [2, 3], "]"], "q": [], "r": {"s": {"t": 1}, "u": None}}
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "n.json").write_text(json.dumps(nested, indent=1))
    rows = J.read_json_elements(spark, str(tmp_path / "n"), level=2, range_bytes=5, chunk_bytes=4).collect()
    assert [(r["parent"], r["key"], json.loads(r["value"])) for r in sorted(rows, key=lambda r: r["at"])] == [
        ("p", None, 1), ("p", None, [2, 3]), ("p", None, "]"), ("r", "s", {"t": 1}), ("r", "u", None)]


@pytest.mark.parametrize("text", ['[1, 2', '[1,, 2]', '["a]', '[1] x', '[1]]'])
def test_what_is_not_json_raises(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(PythonException):
        J.read_json_elements(spark, str(tmp_path / "x.json"), range_bytes=2).collect()


def test_written_object_is_one_file_in_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"k{nasty(rng, 3)}{i}", i, json.dumps(value_of(rng), ensure_ascii=False)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, n int, v string").repartition(7)
    path = J.write_json_object(df, "k", "v", ["n"], path=str(tmp_path / "o" / "one.json"))
    assert list(json.load(open(path)).items()) == [(k, json.loads(v)) for k, _, v in rows]
    df = spark.createDataFrame([("hot" if i % 3 else f"g{i % 2}", i, str(i)) for i in range(500)], "k string, n int, v string")
    path = J.write_json_object(df, "k", "v", ["n"], arrays=True, path=str(tmp_path / "o" / "two.json"))
    want = {}
    for i in range(500):
        want.setdefault("hot" if i % 3 else f"g{i % 2}", []).append(i)
    got = json.load(open(path))
    assert got == want and list(got) == sorted(want)
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["one.json", "two.json"]
    back = J.read_json_elements(spark, path, level=2, range_bytes=100).collect()
    assert [(r["parent"], int(r["value"])) for r in sorted(back, key=lambda r: r["at"])] == [
        (k, n) for k in sorted(want) for n in want[k]]


def test_written_object_without_rows_nulls_and_null_keys(spark, tmp_path):
    empty = spark.createDataFrame([], "k string, v string, piece int, p int")
    assert json.load(open(J.write_json_object(empty, "k", "v", path=str(tmp_path / "e.json")))) == {}
    df = spark.createDataFrame([("a", None, 1, 2), ("b", "2", 3, None)], "k string, v string, piece int, p int")
    assert json.load(open(J.write_json_object(df, "k", "v", path=str(tmp_path / "f.json")))) == {"a": None, "b": 2}
    with pytest.raises(Exception, match="key is null"):
        J.write_json_object(spark.createDataFrame([(None, "1")], "k string, v string"), "k", "v", path=str(tmp_path / "g.json"))


SETS = {"train": [["a, b", "x"], ['"c"', "y"]] * 20, "oos": [["d", "z"]], "val": [["e\n]", "x"]], "test": []}
SLOTS = [{"userInput": {"text": f"a {i}"}, "context": {"requestedSlots": ["time"]} if i % 2 else None, "pos": i,
          "labels": [{"slot": "time", "valueSpan": {"startIndex": i, "endIndex": i + 2}}]} for i in range(30)]
ACTS = {f"d{i}": {"1": {"Hotel-Inform": [["Area", "centre"], ["Name", "a]b"]], "general-bye": [["none", "none"]]},
                  "2": "No Annotation", "3": {}} for i in range(20)} | {"empty": {}}
WOZ = [{"dialogue_idx": i, "dialogue": [{"turn_idx": t, "system_transcript": "hi {", "transcript": "thai, food",
                                         "turn_label": [["food", "thai"]]} for t in range(i % 4)]} for i in range(20)]
SIM = [{"dialogue_id": f"s{i}", "turns": [
    {"user_utterance": {"tokens": ["two", '"'], "slots": [{"slot": "num", "start": 0, "exclusive_end": 1}]},
     "dialogue_state": [{"slot": "num", "value": "two"}]},
    {"system_utterance": {"tokens": ["ok"], "slots": []}, "user_utterance": {"tokens": [], "slots": []},
     "dialogue_state": []}]} for i in range(15)]


@pytest.mark.parametrize("content,whole,ranged", [
    (SETS, lambda s, p: R.read_json_sets(s, p, whole_files=True), R.read_json_sets_by_range),
    (SLOTS, lambda s, p: R.read_json_array(s, p, multi_line=True), R.read_json_array_by_range),
    (ACTS, lambda s, p: R.read_keyed_acts(s, p, whole_files=True), R.read_keyed_acts_by_range),
    (WOZ, lambda s, p: R.read_transcripts(s, p, whole_files=True), R.read_transcripts_by_range),
    (SIM, lambda s, p: R.read_span_dialogues(s, p, whole_files=True), R.read_span_dialogues_by_range)],
    ids=["sets", "slots", "acts", "transcripts", "spans"])
def test_every_layout_by_range_equals_the_whole_file(spark, tmp_path, content, whole, ranged):
    for indent in (None, 2):
        path = tmp_path / f"file{indent}.json"
        path.write_text(json.dumps(content, indent=indent))
        a, b = whole(spark, str(path)), ranged(spark, str(path), range_bytes=150, chunk_bytes=64)
        assert a.columns == b.columns
        rows = sorted(map(repr, a.collect()))
        assert rows and sorted(map(repr, b.collect())) == rows


@pytest.mark.parametrize("arrays", [False, True])
def test_ranges_of_a_written_object_go_by_short_keys_in_the_values_order(spark, tmp_path, monkeypatch, arrays):
    rows = [(f"k{i % 7}", json.dumps("same " * (3000 if i % 2 else 1) + f"{i * 37 % 60:03d}é")) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:5], "k string, v string")
    cls, longest = type(df), []
    ranged = cls.repartitionByRange

    def watched(self, *cols):
        longest.append(max(len(str(r)) for r in self.select(*cols).collect()))
        return ranged(self, *cols)

    monkeypatch.setattr(cls, "repartitionByRange", watched)
    path = J.write_json_object(df, "k", "v", arrays=arrays, path=f"{tmp_path}/object.json")
    got = json.loads(open(path, encoding="utf-8").read(), object_pairs_hook=list)
    want = sorted(rows + rows[:5])
    assert [(k, x) for k, v in got for x in (v if arrays else [v])] == [(k, json.loads(v)) for k, v in want]
    assert longest and max(longest) < 400              # the driver's sample holds such rows
