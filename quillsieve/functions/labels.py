"""Column functions over names of datasets, tasks, layers and models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Datasets by group.
DATASET_GROUPS = {
    "General": ("c4", "oscar", "redpajama", "pile"),
    "Arithmetic Reasoning": ("gsm8k", "svamp", "mawps"),
    "NLU Inference": ("anli_r1", "esnli", "rte"),
    "Commonsense QA": ("boolq", "commonsense_qa", "race", "winogrande"),
    "Translation": ("wmt14", "iwslt"),
    "Coding": ("opc", "ds1000", "mbpp"),
}
# The metric that stands for a task.
TASK_METRICS = {
    "exact_match,flexible-extract": ("gsm8k",),
    "f1,none": ("xquad_es", "xquad_zh"),
    "acc_norm,none": ("arc_challenge", "arc_easy", "hellaswag", "openbookqa"),
}
# Fixed value: the metric of every other task.
DEFAULT_METRIC = "acc,none"
# Sizes in model names, and the last parts of key layers' names.
SIZE_TAGS = ("70B", "8B", "3B")
KEY_LAYERS = (
    r"\.(q_proj|k_proj|v_proj|o_proj|gate_proj|up_proj|down_proj|query|key|value|dense|fc1|fc2|c_attn|c_proj|w1|w2|w3)$"
)


def _cases(value: Column, table: dict[str, tuple[str, ...]], otherwise: Column) -> Column:
    rule = None
    for label, members in table.items():
        condition = value.isin(*members)
        rule = F.when(condition, label) if rule is None else rule.when(condition, label)
    return otherwise if rule is None else rule.otherwise(otherwise)


def calib_group(dataset: Column) -> Column:
    """Group of a calibration dataset; combined names are mixed, unknown and missing ones other."""
    known = _cases(dataset, DATASET_GROUPS, F.lit("Other"))
    return F.when(dataset.isNull(), "Other").when(dataset.contains("_"), "Mixed").otherwise(known)


def metric_for_task(task: Column) -> Column:
    return _cases(task, TASK_METRICS, F.lit(DEFAULT_METRIC))


def task_covered(available: Column, requested: Column) -> Column:
    """Whether a set of task names holds the requested task or one of its subtasks."""
    return F.exists(available, lambda t: (t == requested) | t.startswith(F.concat(requested, F.lit("_"))))


def task_in_group(task: Column, requested: Column) -> Column:
    return (task == requested) | task.startswith(F.concat(requested, F.lit("_")))


def layer_index(layer: Column) -> Column:
    """Number of a layer from its dotted name; null if it has none."""
    found = F.regexp_extract(layer, r"layers?[._](\d+)", 1)
    return F.when(found != "", found.cast("int"))


def layer_component(layer: Column) -> Column:
    """Last part of the dotted name."""
    return F.element_at(F.split(layer, r"\."), -1)


def layer_short(layer: Column) -> Column:
    return F.replace(F.replace(layer, F.lit("model.layers."), F.lit("L")), F.lit("_proj"), F.lit(""))


def key_layer(layer: Column, pattern: str = KEY_LAYERS) -> Column:
    return layer.rlike(pattern)


def coef_variation(variance: Column, mean: Column, absolute: bool = False) -> Column:
    """Deviation over the mean; null where the mean (or its shifted value) is zero."""
    return F.try_divide(F.sqrt(variance), F.abs(mean) if absolute else mean + 1e-8)


def best_accuracy(columns: list[str]) -> Column:
    """Largest of a row's accuracy columns, standard errors left aside; null if all are null."""
    kept = [F.col(f"`{c}`") for c in columns if "acc" in c and "stderr" not in c]
    return kept[0] if len(kept) == 1 else F.greatest(*kept)


def short_model(model: Column) -> Column:
    return F.element_at(F.split(model, "/"), -1)


def display_name(name: Column, shown: dict[str, str]) -> Column:
    """The name that ``shown`` has for a method or dataset; others keep their own."""
    rule = F.lit(None)
    for key, label in shown.items():
        rule = F.when(name == key, label).otherwise(rule)
    return F.coalesce(rule, name)


def size_tag(model: Column) -> Column:
    rule = None
    for tag in SIZE_TAGS:
        rule = F.when(model.contains(tag), tag) if rule is None else rule.when(model.contains(tag), tag)
    return rule.otherwise(model)


def to_number(value: Column) -> Column:
    """A number, or null where the text is none."""
    return value.try_cast("double")
