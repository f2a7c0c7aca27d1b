"""Learning-rate schedule, throughput and cross entropy as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.arrays import let


def learning_rate(
    step: Column,
    *,
    max_lr: float,
    min_lr: float,
    warmup_steps: int,
    max_steps: int,
    constant: bool = False,
) -> Column:
    """Linear warm-up, cosine decay, then the floor; ``constant`` switches all of it off."""
    if constant:
        return F.lit(float(max_lr))
    progress = (step - warmup_steps).cast("double") / F.lit(float(max_steps - warmup_steps))
    cosine = F.lit(0.5) * (F.lit(1.0) + F.cos(F.pi() * progress))
    return (
        F.when(
            step < warmup_steps,
            F.lit(float(max_lr)) * (step + 1).cast("double") / F.lit(float(warmup_steps)),
        )
        .when(step > max_steps, F.lit(float(min_lr)))
        .otherwise(F.lit(float(min_lr)) + cosine * F.lit(float(max_lr - min_lr)))
    )


def tokens_per_step(batch: int, window: int, accumulation: int, world: int) -> int:
    return batch * window * accumulation * world


def accumulation_steps(total_tokens: int, batch: int, window: int, world: int) -> int:
    """Micro-batches per step; the total has to be an exact multiple."""
    micro = batch * window * world
    if total_tokens % micro:
        raise ValueError(f"{total_tokens} tokens per step is not a multiple of {micro}")
    return total_tokens // micro


def throughput(tokens: int, seconds: Column) -> Column:
    return F.try_divide(F.lit(float(tokens)), seconds)


def flops_utilisation(
    tokens: int, seconds: Column, parameters: int, peak_flops: float, world: int
) -> Column:
    """Share of peak under the 6-FLOPs-per-parameter-and-token rule."""
    return F.try_divide(
        F.lit(6.0 * parameters * tokens), seconds * F.lit(peak_flops) * F.lit(float(world))
    )


def cross_entropy(logits: Column, target: Column) -> Column:
    """``logsumexp(z) - z[target]`` with the usual shift by the maximum; target is 0-based."""
    return let(
        logits,
        lambda z: let(
            F.array_max(z),
            lambda top: top
            + F.ln(F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))
            - F.get(z, target),
        ),
    )
