"""Conversions by providers that may fail: a failure is a column beside the result, and the next provider gets those rows alone."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import save

#: Takes a file's bytes, its width and height; gives the converted bytes or raises.
Provider = Callable[[bytes, int, int], bytes]
OUTCOME = "image_id long, provider string, result binary, failure string"


def attempt(images: DataFrame, name: str, provider: Provider) -> DataFrame:
    """(image_id, provider, result, failure) of images (image_id, body, width, height), one row each.

    What a provider raises becomes the failure: `memory` where it ran out of it, else `error`. One bad image never
    fails the job.
    """

    def run(batches):
        for b in batches:
            ids, results, failures = b.column("image_id"), [], []
            for body, w, h in zip(*(b.column(c).to_pylist() for c in ("body", "width", "height")), strict=True):
                try:
                    results.append(provider(body, w, h))
                    failures.append(None)
                except MemoryError:
                    results.append(None)
                    failures.append("memory")
                except Exception:
                    results.append(None)
                    failures.append("error")
            yield pa.RecordBatch.from_arrays([ids, pa.array([name] * len(results), pa.string()), pa.array(results, pa.binary()), pa.array(failures, pa.string())], ["image_id", "provider", "result", "failure"])

    return images.select(F.col("image_id").cast("long").alias("image_id"), "body", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")).mapInArrow(run, OUTCOME)


def convert(images: DataFrame, chain: list[tuple[str, Provider]]) -> DataFrame:
    """The outcome of the first provider of `chain` that converts an image, or of the last one that was asked.

    A failure goes on to the next provider, but one for want of memory doesn't: more of the same would follow. Each
    provider's outcomes are written, so none is asked twice for an image, and those that failed are the next one's
    input.
    """
    done, todo = None, images
    for k, (name, provider) in enumerate(chain):
        out = save(attempt(todo, name, provider), f"converted-{name}")
        last = k == len(chain) - 1
        failed = F.coalesce(F.col("failure") == "error", F.lit(False))
        settled = out if last else out.where(~failed)
        done = settled if done is None else done.unionByName(settled)
        if not last:
            again = out.where(failed).select(F.col("image_id").alias("_id"))
            todo = todo.join(again, F.col("image_id") == F.col("_id"), "left_semi")
    return done


def runs_of_colour(most: int, limit: int) -> Provider:
    """SVG of one rectangle for each run of equal pixels in a row; fails beyond `most` of them, or `limit` bytes of pixels."""

    def provider(body: bytes, width: int, height: int) -> bytes:
        if len(body) > limit:
            raise MemoryError
        out = []
        for y in range(height):
            x = 0
            while x < width:
                at = (y * width + x) * 4
                pixel, end = body[at : at + 4], x + 1
                while end < width and body[(y * width + end) * 4 : (y * width + end) * 4 + 4] == pixel:
                    end += 1
                if pixel[3]:
                    out.append(f'<rect x="{x}" y="{y}" width="{end - x}" height="1" fill="#{pixel[:3].hex()}"/>')
                x = end
        if len(out) > most:
            raise ValueError("too many pieces")
        return f'<svg viewBox="0 0 {width} {height}">{"".join(out)}</svg>'.encode()

    return provider


def embedded(body: bytes, width: int, height: int) -> bytes:
    """SVG that holds the pixels as they are: the way out when nothing else works."""
    return f'<svg viewBox="0 0 {width} {height}"><metadata>{base64.b64encode(body).decode()}</metadata></svg>'.encode()
