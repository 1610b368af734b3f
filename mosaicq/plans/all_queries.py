"""Imports every module of queries, so that the registry is full."""

from mosaicq.plans import blocks, classify, costs, files, kernels, metrics, rows, segments, stages, streams, support, windows  # noqa: F401
from mosaicq.plans.catalog import ORACLES, QUERIES  # noqa: F401
