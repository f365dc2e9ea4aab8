"""Registries: tasks, and the default settings of the experiments whose outputs the engine reads."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Task:
    """Where a task's rows come from, its columns, and the metric that is reported. Local tasks are made by this engine."""

    source: str
    columns: tuple[str, str | None]
    train: str
    validation: str
    metric: str = "accuracy"


#: The tasks that records name.
TASKS = {
    "paws-x": Task("paws-x/en", ("sentence1", "sentence2"), "train", "validation"),
    "cola": Task("glue/cola", ("sentence", None), "train", "validation", "mcc"),
    "rte": Task("glue/rte", ("sentence1", "sentence2"), "train", "validation"),
    **{f"longrange_d{d}": Task(f"longrange_d{d}", ("sentence", None), "train", "val") for d in (8, 16, 24)},
    **{f"dyck_L{n}_t3": Task(f"dyck_L{n}_t3", ("sentence", None), "train", "val") for n in (40, 60)},
}

#: The settings that records were made with.
DEFAULTS = {
    "corpus": {"target_tokens": 50_000_000, "seed": 0, "groups": "text,protein,shuffled,randomaa"},
    "pretraining": {"seed": 0, "base": "gpt2", "epochs": 1, "bs": 16, "grad_accum": 2, "lr": 5e-5, "max_steps": -1, "block": 512},
    "pilot": {"epochs": 4, "seed": 56, "max_length": 256, "bs": 32, "lr": 1e-5},
    "distribution": {"n_seeds": 100, "start": 0, "epochs": 4, "bs": 64, "lr": 1e-5},
    "remote": {"mix_remote": 0.7, "n_source": 20_000, "n_seeds": 10, "start": 0},
    "backbone": {"n_seeds": 10, "start": 0},
    "bidirectional": {"n_seeds": 15, "epochs": 4, "bs": 32, "lr": 1e-5},
    "structural": {"seed": 0, "base": "gpt2", "fractions": "0.01,0.05,0.1,1.0", "tasks": "paws-x,cola,rte"},
    "dyck": {"length": 40, "n_types": 3, "n_train": 8000, "n_val": 2000, "seed": 0},
    "longrange": {"n_distract": 12, "n_train": 8000, "n_val": 2000, "seed": 0},
    "forward": {"n_seeds": 5},
    "cka": {"n": 1000},
    "dynamics": {"seeds": "0,1,2", "epochs": 3, "bs": 32, "eval_every": 60},
    "heads": {"n": 300},
    "forward_heads": {"n": 300},
    "selectivity": {"n": 400},
    "probe": {"n": 2000},
}
