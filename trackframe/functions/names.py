"""Columns read out of file and folder names, times and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Name formats of the clips, frames and patches.
CLIP_FOLDER = r"([0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{2}_[0-9]{2}_[0-9]{2})"
CLIP_TIME = "yyyy-MM-dd_HH_mm_ss"
YES_NO = {"yes": 1, "no": 0}


def clip_stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def clip_time(path: Column) -> Column:
    stem = F.regexp_extract(path, CLIP_FOLDER, 1)
    return F.to_timestamp_ntz(F.nullif(stem, F.lit("")), F.lit(CLIP_TIME))


def clip_hour(path: Column) -> Column:
    return F.hour(clip_time(path))


def frame_of_image(image: Column) -> Column:
    """Frame number: the digits after the last underscore of an image name."""
    digits = F.regexp_extract(clip_stem(image), r"_(\d+)$", 1)
    return F.nullif(digits, F.lit("")).cast("int")


def base_image(patch_image: Column) -> Column:
    """Image a patch was cut from: the name without its trailing patch number."""
    return F.regexp_replace(clip_stem(patch_image), r"_\d+$", "")


def yes_no_label(value: Column) -> Column:
    clean = F.lower(F.trim(value))
    label = F.lit(None).cast("int")
    for text, number in YES_NO.items():
        label = F.when(clean == text, F.lit(number)).otherwise(label)
    return label


def cyclic_hour(hour: Column) -> list[Column]:
    turn = hour * F.lit(2.0) * F.pi() / F.lit(24.0)
    return [F.sin(turn).alias("hour_sin"), F.cos(turn).alias("hour_cos")]


def relabel(label: Column, mapping: dict[int, int]) -> Column:
    out = label
    for old, new in mapping.items():
        out = F.when(label == old, F.lit(new)).otherwise(out)
    return out
