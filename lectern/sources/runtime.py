"""Where models run: processors a task may use, execution providers, and what is installed."""

from __future__ import annotations

import importlib.util
import math
import os
from pathlib import Path

from lectern.sources.models import ModelError

DEVICES = ("cpu", "cuda", "auto")
CPU, CUDA = "CPUExecutionProvider", "CUDAExecutionProvider"
CONTROL_GROUPS = Path("/sys/fs/cgroup")


def installed(module: str) -> bool:
    """Whether a module could be imported, without importing it."""
    try:
        return importlib.util.find_spec(module) is not None
    except ModuleNotFoundError:
        return False


def _numbers(path: Path) -> list[int] | None:
    """The whole numbers of a small file; None where there is none or it holds something else."""
    try:
        return [int(x) for x in path.read_text().split()]
    except (OSError, ValueError):
        return None


def allowed_cpus(root: Path = CONTROL_GROUPS) -> float | None:
    """CPUs that a control group of either version allows; None without a limit."""
    for files in (["cpu.max"], ["cpu/cpu.cfs_quota_us", "cpu/cpu.cfs_period_us"]):
        read = [_numbers(root / f) for f in files]
        if None not in read and len(pair := sum(read, [])) == 2:
            return pair[0] / pair[1] if min(pair) > 0 else None
    return None


def usable_cpus(root: Path = CONTROL_GROUPS) -> int:
    """CPUs that this process may really use: its affinity, within its control group's limit."""
    own = len(os.sched_getaffinity(0)) if hasattr(os, "sched_getaffinity") else os.cpu_count() or 1
    limit = allowed_cpus(root)
    return max(1, own if limit is None else min(own, max(1, math.ceil(limit))))


def execution_providers(device: str, available: list[str] | None = None) -> list[str]:
    """What ONNX Runtime tries for a device, in order; ModelError if cuda is asked for and not there."""
    if device not in DEVICES:
        raise ValueError(f"device is one of {', '.join(DEVICES)}")
    if device == "cpu":
        return [CPU]
    if available is None:
        import onnxruntime

        available = onnxruntime.get_available_providers()
    if CUDA not in available and device == "cuda":
        raise ModelError("ONNX Runtime has no CUDA here")
    return [p for p in (CUDA, CPU) if p == CPU or p in available]


def session(path: str, device: str = "cpu", threads: int = 1) -> object:
    """An ONNX Runtime session; one thread by default, as each task slot runs one."""
    import onnxruntime

    if threads < 1:
        raise ValueError("threads is at least 1")
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads, options.inter_op_num_threads = threads, 1
    try:
        return onnxruntime.InferenceSession(path, options, providers=execution_providers(device))
    except Exception as e:  # noqa: BLE001 - the runtime's own error types are not public
        raise ModelError(f"cannot load {path}: {type(e).__name__}") from None
