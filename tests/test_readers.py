"""Readers on files laid out as the benchmark's are: indented whole-file JSON, typed belief state, acts."""

import json

import pytest

from parlance.operators import dialogue as D
from parlance.sources import readers as R
from parlance.sources import registry

DIALOGUES = {
    "MUL1.json": {"goal": {}, "log": [
        {"text": "i want a cheap hotel", "metadata": {}},
        {"text": "booked!", "metadata": {
            "hotel": {"book": {"booked": [{"name": "acorn guesthouse", "people": "4"}], "people": "3", "stay": ""},
                      "semi": {"area": "centre", "name": "acorn"}},
            "taxi": {"book": {"booked": []}, "semi": {"leaveAt": "5pm"}}}}]},
    "MUL2.json": {"log": []},
}
ACTS = {"MUL1": {"1": {"Hotel-Inform": [["Area", "centre"], ["Name", "acorn"]], "general-bye": [["none", "none"]]},
                 "2": "No Annotation"}}
WOZ = [{"dialogue_idx": 7, "dialogue": [{"turn_idx": 0, "system_transcript": "", "transcript": "thai food",
                                         "turn_label": [["food", "thai"]]}]}]
SIM = [{"dialogue_id": "s1", "turns": [
    {"user_utterance": {"tokens": ["two", "tickets"], "slots": [{"slot": "num", "start": 0, "exclusive_end": 1}]},
     "dialogue_state": [{"slot": "num", "value": "two"}]},
    {"system_utterance": {"tokens": ["ok"], "slots": []}, "user_utterance": {"tokens": [], "slots": []},
     "dialogue_state": []}]}]


def put(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps(value, indent=2))
    return str(folder / name)


def test_indented_files_are_read_whole(spark, tmp_path):
    path = put(tmp_path, "sets.json", {"train": [["a b", "x"], ["c", "y"]], "oos": [["d", "z"]]})
    assert {tuple(r) for r in R.read_json_sets(spark, path, whole_files=True).collect()} == {
        ("train", "a b", "x"), ("train", "c", "y")}
    path = put(tmp_path, "dials.json", DIALOGUES)
    u = D.explode_dialogues(R.read_keyed_logs(spark, path, whole_files=True))
    rows = sorted(tuple(r) for r in u.select("dialog_id", "utt_idx", "is_sys", "text").collect())
    assert rows == [("MUL1.json", 0, False, "i want a cheap hotel"), ("MUL1.json", 1, True, "booked!")]


def test_files_that_do_not_parse_fail(spark, tmp_path):
    path = put(tmp_path, "sets.json", {"train": [["a", "x"]]})
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_json_sets(spark, path).collect()             # an indented file read by line
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_keyed_logs(spark, path).collect()


def test_belief_state(spark, tmp_path):
    path = put(tmp_path, "dials.json", DIALOGUES)
    u = D.explode_dialogues(R.read_keyed_logs(spark, path, whole_files=True))
    got = {tuple(r)[2:] for r in R.belief_state(u).collect()}
    assert got == {("hotel", "book", "people", "3", "4"), ("hotel", "book", "stay", "", None),
                   ("hotel", "semi", "area", "centre", None), ("hotel", "semi", "name", "acorn", "acorn guesthouse"),
                   ("taxi", "semi", "leaveAt", "5pm", None)}
    state = {(r.slot, r.value) for r in D.booked_overrides(R.belief_state(u)).collect()}
    assert ("hotel-book_people", "4") in state and ("hotel-name", "acorn guest house") in state
    assert ("taxi-leaveAt", "17:00") in state and ("hotel-book_stay", "none") in state


def test_registry_reads_every_dialogue_set(spark, tmp_path):
    put(tmp_path / "multiwoz21", "train_dials.json", DIALOGUES)
    put(tmp_path / "multiwoz21", "dialogue_acts.json", ACTS)
    put(tmp_path / "woz2", "woz_validate_en.json", WOZ)
    put(tmp_path / "sim-m", "dev.json", SIM)
    root = str(tmp_path)
    assert registry.load(spark, "multiwoz21", "train", root).count() == 1
    acts = registry.load_acts(spark, "multiwoz21", root)
    assert {(r.dialog_id, r.turn, r.act, r.slot, r.value, r.annotated) for r in acts.collect()} == {
        ("MUL1", 1, "Hotel-Inform", "Area", "centre", True), ("MUL1", 1, "Hotel-Inform", "Name", "acorn", True),
        ("MUL1", 1, "general-bye", "none", "none", True), ("MUL1", 2, None, None, None, False)}
    assert {(r.turn, r.slot, r.value) for r in D.load_acts(acts).collect()} == {
        (1, "hotel-area", "centre"), (1, "hotel-name", "acorn")}
    woz = registry.load(spark, "woz2", "val", root).collect()
    assert [(r.dialog_id, r.turn, r.transcript, r.turn_label) for r in woz] == [("7", 0, "thai food", [["food", "thai"]])]
    sim = sorted(registry.load(spark, "sim-m", "val", root).collect(), key=lambda r: r.turn)
    assert [r.turn for r in sim] == [0, 1] and sim[0].system_utterance is None
    assert sim[0].user_utterance.slots[0].exclusive_end == 1
    with pytest.raises(ValueError):
        registry.load(spark, "woz2", "dev", root)


def test_configuration_files_by_name(spark, tmp_path):
    from parlance.config import config_tables, load_dataset_config, read_config_frame
    from parlance.sources.sinks import write_named_files
    texts = {"one": {"class_types": ["none", "copy_value"], "slots": ["hotel-area"], "label_maps": {"north": ["n", "up"]}},
             "two": {"class_types": ["none"], "slots": [], "label_maps": {}}}
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()], "name string, value string")
    path = str(tmp_path / "configs")
    for _ in range(2):                                     # a job that runs again leaves the same files
        assert write_named_files(rows, "name", "value", path) == path
    assert sorted(x.name for x in (tmp_path / "configs").iterdir() if x.suffix == ".json") == ["one.json", "two.json"]
    ct, sl, lv = config_tables(read_config_frame(spark, path, "dataset"))
    assert sorted(map(tuple, ct.collect())) == [("one", 0, "none"), ("one", 1, "copy_value"), ("two", 0, "none")]
    assert [tuple(r) for r in sl.collect()] == [("one", 0, "hotel-area")]
    assert sorted(map(tuple, lv.collect())) == [("one", "north", 0, "n"), ("one", "north", 1, "up")]
    assert load_dataset_config(spark, f"{path}/one.json").label_maps == {"north": ["n", "up"]}
