"""Explicit schemas: pairs, model outputs and experiment records, in Spark's schema language. Files are never read by inference."""

from __future__ import annotations

PAIR = "sentence1 string, sentence2 string, label int"
SENTENCE = "sentence string, label int"
PREDICTIONS = "direction string, model string, seed int, split string, example_id bigint, label int, logit0 double, logit1 double"
HIDDEN_STATES = "model string, modality string, layer int, example_id bigint, features array<double>"
ATTENTION = "model string, modality string, pair_id bigint, layer int, head int, q int, k int, w double"
#: Predictions of sentence tasks by model, of tasks by pretraining group and share of the training rows, and of splits of a run.
TASK_PREDICTIONS = "task string, model string, hf string, seed bigint, example_id bigint, label int, logit0 double, logit1 double"
GROUP_PREDICTIONS = "task string, `group` string, frac double, base string, seed bigint, example_id bigint, label int, logit0 double, logit1 double"
RUN_PREDICTIONS = "model string, seed bigint, split string, example_id bigint, label int, logit0 double, logit1 double"
TOKEN_PAIRS = "pair_id bigint, modality string, label int, a array<string>, b array<string>"
TRAINING_STEPS = "direction string, seed bigint, step int, example_id bigint, label int, logit0 double, logit1 double"

_M2 = "struct<acc_raw: double, acc_flipbest: double>"
_M3 = "struct<acc_raw: double, acc_flipbest: double, f1: double>"
_CONFUSED = "struct<tag: string, accuracy: double, f1: double, label_flipped: boolean, confusion_matrix: array<array<bigint>>, n: bigint>"

#: Records of runs by kind; a field that a file lacks reads as null.
RECORDS = {
    "bidirectional": f"seed bigint, direction string, indomain {_M2}, transfer {_M2}",
    "sentence_tasks": "task string, model string, hf string, metric string, seed bigint, score double, acc double, unk_frac double",
    "crossmodal": "task string, model string, hf string, seed bigint, acc double, f1 double, unk_frac double",
    "structural": "task string, `group` string, frac double, metric string, score double, seed bigint, base string",
    "forward_source": "source string, target string, seed bigint, acc_flipbest double, auc double",
    "backbone": f"seed bigint, model string, baseline_pawsx_test {_M3}, protein_indomain {_M3}, transfer_pawsx_test {_M3}, transfer_pawsx_val {_M3}",
    "remote": f"seed bigint, mix_remote double, n_source bigint, baseline_pawsx_test {_M3}, source_indomain {_M3}, transfer_pawsx_test {_M3}, transfer_pawsx_val {_M3}",
    "cka": "model string, path string, per_layer map<string, struct<cka: double, cka_shuffled: double>>",
    "dynamics": "direction string, seed bigint, trajectory array<struct<step: int, transfer_flip: double>>",
    "heads": "model string, n_pairs bigint, max_diff_attn double, mean_diff_attn double, top_heads array<array<double>>",
    "forward_heads": "model string, n_pairs bigint, max_bio_diff_attn double, top_heads array<array<double>>",
    "selectivity": "model string, modality string, n bigint, `max` double, z_of_max double, mean_over_heads double, max_head array<bigint>",
    "probe": "base string, `group` string, seed bigint, best_layer bigint, probe_acc_last double, probe_acc_best double, per_layer map<string, double>",
    "pilot": f"config struct<epochs: bigint, seed: bigint, max_length: bigint, bs: bigint, lr: double>, model string, baseline_untrained_pawsx {_CONFUSED}, bio_indomain_protein_val {_CONFUSED}, transfer_pawsx_test {_CONFUSED}, transfer_pawsx_val {_CONFUSED}",
    "manifest": "target_tokens bigint, seed bigint, groups map<string, struct<file: string, tokens: bigint, lines: bigint>>",
}
