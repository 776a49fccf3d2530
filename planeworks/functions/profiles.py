"""Node profiles (JSON text) checked by column rules: every reason a profile is refused, for whole tables of nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planeworks.functions.policy import SHA_PATTERN, reasons

#: The fields of a profile and of its parts.
FIELDS = ("schema", "node_id", "node_count", "paths", "execution", "review_budget", "inference")
PATHS = ("local_cache_root", "local_work_root", "source_root", "publish_root")
BUDGET = {"max_views": (2, 64), "max_display_dimension": (64, 2048), "max_raw_crop_pixels": (1, 16_777_216)}
TEXTS = ("endpoint", "model_id", "model_revision", "quantization", "prompt_sha256", "image_preprocessing_revision")
LIMITS = {"request_timeout_seconds": (1, 600), "max_attempts": (1, 3)}


def _keys(json: Column, path: str, names: tuple[str, ...]) -> Column:
    """Exactly these fields."""
    found = F.json_object_keys(F.get_json_object(json, path))
    return F.coalesce(F.sort_array(found) == F.array(*[F.lit(n) for n in sorted(names)]), F.lit(False))


def _whole(json: Column, path: str, low: Column | int, high: Column | int) -> Column:
    """An integer in range."""
    raw = F.get_json_object(json, path)
    return F.coalesce(raw.rlike(r"^-?[0-9]{1,18}$") & raw.try_cast("bigint").between(low, high), F.lit(False))


def profile_reasons(json: Column) -> Column:
    """Why a profile is refused, in order; empty if it isn't."""
    get = lambda path: F.get_json_object(json, path)
    count = get("$.node_count").try_cast("bigint")
    absolute = [get(f"$.paths.{p}").isNull() | get(f"$.paths.{p}").startswith("/") for p in PATHS]
    texts = [get(f"$.inference.{t}").isNull() | (F.trim(get(f"$.inference.{t}")) != "") for t in TEXTS]
    every = lambda rules: F.forall(F.array(*rules), lambda x: x)
    sha = get("$.inference.prompt_sha256")
    return reasons(
        (~_keys(json, "$", FIELDS), "fields"),
        (~(_whole(json, "$.node_count", 1, 64) & _whole(json, "$.node_id", F.lit(0), count - 1)), "node"),
        (~_keys(json, "$.paths", PATHS), "path_fields"),
        (~every(absolute), "relative_path"),
        (~(_keys(json, "$.execution", ("active_sessions_per_node", "cpu_threads_per_process")) & _whole(json, "$.execution.active_sessions_per_node", 1, 1) & _whole(json, "$.execution.cpu_threads_per_process", 1, 1)), "execution"),
        (~(_keys(json, "$.review_budget", tuple(BUDGET)) & every([_whole(json, f"$.review_budget.{k}", a, b) for k, (a, b) in BUDGET.items()])), "budget"),
        (~_keys(json, "$.inference", (*TEXTS, *LIMITS)), "inference_fields"),
        (~every(texts), "inference_text"),
        (~every([_whole(json, f"$.inference.{k}", a, b) for k, (a, b) in LIMITS.items()]), "inference_limits"),
        (sha.isNotNull() & ~sha.rlike(SHA_PATTERN), "prompt_sha256"),
    )


def blockers(cache_type: Column, work_type: Column, cache: Column, work: Column, remote: tuple[str, ...] = ("nfs", "nfs4", "cifs", "smb3", "ceph", "glusterfs", "lustre")) -> Column:
    """Why a node isn't ready: paths not set, on remote mounts, or nested. Types as sinks.filesystem_type gives them."""
    away = lambda t: t.isNull() | t.isin(*remote) | t.startswith("fuse.")
    nested = (cache == work) | cache.startswith(F.concat(work, F.lit("/"))) | work.startswith(F.concat(cache, F.lit("/")))
    return reasons((cache.isNull(), "cache_not_set"), (work.isNull(), "work_not_set"), (cache.isNotNull() & away(cache_type), "cache_not_local"), (work.isNotNull() & away(work_type), "work_not_local"), (nested, "nested_paths"))
