"""Texts that models are asked with, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks of the models' chat and sound formats.
TURN, TURN_END = "<|im_start|>", "<|im_end|>"
SOUND, SOUND_PAD, SOUND_END = "<|audio_start|>", "<|audio_pad|>", "<|audio_end|>"
TIME, SPEECH, IMAGE = "<timestamp>", "<asr_text>", "<image>"


def _sound(pads: Column) -> Column:
    return F.concat(F.lit(SOUND), F.repeat(F.lit(SOUND_PAD), pads), F.lit(SOUND_END))


def speech_prompt(context: Column, language: Column, pads: Column) -> Column:
    """A transcription request: context in the system's turn, `pads` places for sound, and the language if it is known."""
    opening = F.when(language.isNotNull(), F.concat(F.lit("language "), language, F.lit(SPEECH))).otherwise("")
    return F.concat(F.lit(f"{TURN}system\n"), F.coalesce(context, F.lit("")), F.lit(f"{TURN_END}\n{TURN}user\n"), _sound(pads), F.lit(f"{TURN_END}\n{TURN}assistant\n"), opening)


def image_prompt(text: Column) -> Column:
    return F.concat(F.lit(IMAGE), text)


def image_ids(begin: int, pad: int, pads: Column, text_ids: Column) -> Column:
    """Token ids of an image request: the begin id, a pad id per place of the image, then the text's ids."""
    return F.concat(F.array(F.lit(begin)), F.array_repeat(F.lit(pad), pads), text_ids)


def alignment_prompt(units: Column, pads: Column) -> Column:
    """The sound's places, then each unit with two places for its times."""
    return F.concat(_sound(pads), F.array_join(F.transform(units, lambda u: F.concat(u, F.lit(TIME * 2))), ""))
