"""Prompts and SFT rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The templates as the models were trained on them, slips included. system: before the first human turn; first and human: a human turn with the message at {m}; gpt: an answer.
TEMPLATES = {
    "pure": {"first": "In: {m}\nOut: ", "human": "In: {m}\nOut: ", "gpt": "{m}</s>"},
    "qa": {"first": "Question: {m}\nAnswer: ", "human": "Question: {m}\nAnswer: ", "gpt": "{m}"},
    "vicuna": {
        "first": "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions. USER: {m} ASSISTANT: ",
        "human": "USER: {m} ASSISTANT: ",
        "gpt": "{m}</s>",
    },
    "phi3": {"first": "<|user|>\n{m}<|end|>\n<|assistant|>\n", "human": "<|user|>\n{m}<|end|>\n<|assistant|>\n", "gpt": "{m}<|end|>\n"},
    "qwen2": {
        "first": "<s><|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n{m}<|im_end|>assistant\n",
        "human": "<|im_start|>user\n{m}<|im_end|>assistant\n",
        "gpt": "{m}<|im_end|>\n",
    },
}
#: Templates whose system text is a parameter: {s} stands for it.
SYSTEM_TEMPLATES = {
    "llama2": {"first": "<s>[INST] <<SYS>\n{s}\n<</SYS>>\n\n{m} [/INST] ", "human": "<s>[INST] {m} [/INST] ", "gpt": "{m}</s>"},
    "llama3": {
        "first": "<|start_header_id|>system<|end_header_id|>\n\nYou are a helpful, respectful, and honest assistant.<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n{m}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
        "human": "<|start_header_id|>user<|end_header_id|>\n\n{m}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
        "gpt": "{m}<|eot_id|>",
    },
}
#: Fixed value: the default of {s}.
SYSTEM = "You are a helpful language and vision assistant. You are able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language."
PATCHES = 729


def _filled(template: str, message: Column) -> Column:
    before, after = template.split("{m}")
    return F.concat(F.lit(before), message, F.lit(after))


def turn_text(family: str, at: Column, message: Column, system: str = SYSTEM) -> Column:
    """The text of turn `at` (even: human, odd: the answer); messages are stripped, an empty answer is one space."""
    t = TEMPLATES.get(family) or {k: v.replace("{s}", system) for k, v in SYSTEM_TEMPLATES[family].items()}
    m = F.btrim(message, F.lit(" \t\n\r\x0b\x0c"))
    answer = F.when(m == "", F.lit(" ")).otherwise(m)
    return F.when(at == 0, _filled(t["first"], m)).when(F.pmod(at, F.lit(2)) == 0, _filled(t["human"], m)).otherwise(_filled(t["gpt"], answer))


def conversation_prompt(turns: DataFrame, family: str) -> DataFrame:
    """(conv_id, at, message) -> conv_id, prompt, without spaces at its end."""
    rows = turns.select("conv_id", "at", turn_text(family, F.col("at"), F.col("message")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "")
    return rows.groupBy("conv_id").agg(F.rtrim(joined).alias("prompt"))


def human_turns_masked(turn_ids: Column, most: int, ignore: int = -100) -> tuple[Column, Column]:
    """(input_ids, labels) of an array of each turn's ids: even turns are not learnt; cut at `most`."""
    ids = F.flatten(turn_ids)
    masked = F.flatten(F.transform(turn_ids, lambda t, i: F.when(F.pmod(i, F.lit(2)) == 0, F.transform(t, lambda x: F.lit(ignore))).otherwise(t)))
    return F.slice(ids, 1, most), F.slice(masked, 1, most)


def sft_length(words: Column) -> Column:
    """Patches and words, for rows without an image as well."""
    return F.lit(PATCHES) + words


def modality_length(kind: str, words: Column, image_marks: Column, patches: int = PATCHES) -> Column:
    """Align counts patches and words without image marks, finetune the words with them."""
    return F.lit(patches) + words - image_marks if kind == "align" else words


# The task prompts by kind, with {question} and {extra} where these stand, and the parts of a few-shot prompt.
TASK_PROMPTS = {
    "vqa": "\n{question}\nAnswer the question using a single word or phrase.",
    "vqa_uncertain": "\n{question}\nWhen the provided information is insufficient, respond with 'Unanswerable'.\nAnswer the question using a single word or phrase.",
    "true_false": '\nBased on the image, is this statement "True" or "False"? {question}\nRespond with "True" or "False" directly.',
    "contrast": '\nDoes the following caption match the image? Caption: "{question}"\nRespond with "True" or "False" directly.',
    "multiple_choice": "\n{question}\n{extra}\nAnswer with the option's letter from the given choices directly.",
    "bbox": '\nPlease provide the bounding box coordinate of the region this sentence describes: "{question}"',
    "caption": "\nProvide a short image description.",
}
FEW_SHOT_QUESTION, FEW_SHOT_ANSWER, FEW_SHOT_END = "<image>\nQuestion: ", "\nAnswer:", "<|endofchunk|>"


def question_prompt(kind: str, question: Column, extra: Column | None = None) -> Column:
    """The prompt of a kind in TASK_PROMPTS; extra: the lettered options of multiple_choice."""
    if kind not in TASK_PROMPTS:
        raise ValueError(kind)
    fields = {"{question}": question, "{extra}": extra}
    return F.concat(*(fields.get(part, F.lit(part)) for part in re.split(r"(\{\w+\})", TASK_PROMPTS[kind]) if part))


def few_shot(demos: Column, question: Column) -> Column:
    """Demonstrations (array of question, answer), then the question."""
    shown = F.array_join(F.transform(demos, lambda d: F.concat(F.lit(FEW_SHOT_QUESTION), d["question"], F.lit(FEW_SHOT_ANSWER + " "), d["answer"], F.lit(FEW_SHOT_END))), "")
    return F.concat(shown, F.lit(FEW_SHOT_QUESTION), question, F.lit(FEW_SHOT_ANSWER))


def without_ocr(question: Column) -> Column:
    """The question up to its OCR tokens."""
    return F.substring_index(question, "\nReference OCR token:", 1)


def pair_to_conversation(rows: DataFrame) -> DataFrame:
    """(id, image, question, answer) -> id, image, conversations of two turns."""
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    human = turn("human", F.concat(F.lit("<image>\n"), F.col("question")))
    return rows.select("id", "image", F.array(human, turn("gpt", F.col("answer"))).alias("conversations"))
