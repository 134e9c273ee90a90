"""SC12: dataset name -> task, reader and file layout, one shared interface.

``load(spark, name, split, root)`` returns the split as a DataFrame with the
reader's schema; tasks map to the score used for the dataset (A9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import readers as R

# The seven benchmark datasets, their task and stored layout; the four dialogue-state sets.
DATASETS = {
    "banking": ("intent", "csv"), "hwu": ("intent", "csv"), "clinc": ("intent", "csv"),
    "restaurant8k": ("slot", "json"), "dstc8": ("slot", "json"), "top": ("top", "txt"),
    "multiwoz": ("dst", "json_keyed"),
    "woz2": ("dst", "transcripts"), "sim-m": ("dst", "spans"), "sim-r": ("dst", "spans"),
    "multiwoz21": ("dst", "dialogues"),
}
SPLITS = ("train", "val", "test", "train_10", "train_5")
# File names of the dialogue-state sets by split.
DIALOGUE_FILES = {
    "woz2": {"train": "woz_train_en.json", "val": "woz_validate_en.json", "test": "woz_test_en.json"},
    "sim-m": {"train": "train.json", "val": "dev.json", "test": "test.json"},
    "sim-r": {"train": "train.json", "val": "dev.json", "test": "test.json"},
    "multiwoz21": {"train": "train_dials.json", "val": "val_dials.json", "test": "test_dials.json"},
}
ACTS_FILE = "dialogue_acts.json"

_READERS = {
    "csv": lambda spark, path: R.read_intent_csv(spark, path),
    "json": lambda spark, path: R.read_json_array(spark, path, multi_line=True),
    "txt": lambda spark, path: R.read_tagged_lines(spark, path),
    "json_keyed": lambda spark, path: R.read_keyed_logs(spark, path, whole_files=True),
    "dialogues": lambda spark, path: R.read_keyed_logs(spark, path, whole_files=True),
    "transcripts": lambda spark, path: R.read_transcripts(spark, path, whole_files=True),
    "spans": lambda spark, path: R.read_span_dialogues(spark, path, whole_files=True),
}
# the same rows of JSON files of any size, each read by many tasks
_RANGE_READERS = {
    "json": R.read_json_array_by_range, "json_keyed": R.read_keyed_logs_by_range,
    "dialogues": R.read_keyed_logs_by_range, "transcripts": R.read_transcripts_by_range,
    "spans": R.read_span_dialogues_by_range,
}


def task_of(name: str) -> str:
    return DATASETS[name][0]


def path_of(root: str, name: str, split: str) -> str:
    layout = DATASETS[name][1]
    if name in DIALOGUE_FILES:
        return f"{root.rstrip('/')}/{name}/{DIALOGUE_FILES[name][split]}"
    ext = {"csv": "csv", "json": "json", "txt": "txt", "json_keyed": "json"}[layout]
    return f"{root.rstrip('/')}/{name}/{split}.{ext}"


def load_acts(spark: SparkSession, name: str, root: str, by_range: bool = False) -> DataFrame:
    """The act file that stands beside the dialogues of a keyed set."""
    path = f"{root.rstrip('/')}/{name}/{ACTS_FILE}"
    return R.read_keyed_acts_by_range(spark, path) if by_range else R.read_keyed_acts(spark, path, whole_files=True)


def load(spark: SparkSession, name: str, split: str, root: str, by_range: bool = False) -> DataFrame:
    """The rows of a data set's split; ``by_range``: a JSON file is cut into byte ranges instead of read by one task."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    if by_range and DATASETS[name][1] in _RANGE_READERS:
        return _RANGE_READERS[DATASETS[name][1]](spark, path_of(root, name, split))
    return _READERS[DATASETS[name][1]](spark, path_of(root, name, split))
