"""End-to-end plans: conversion of a source to requests, and batch runs over requests."""

from .benchmark import benchmark_requests
from .convert import Conversion, csv_to_requests, directory_to_requests, json_to_requests, vision_to_requests
from .run import RunOutput, run_batch, run_summary

__all__ = [
    "Conversion",
    "RunOutput",
    "benchmark_requests",
    "csv_to_requests",
    "directory_to_requests",
    "json_to_requests",
    "run_batch",
    "run_summary",
    "vision_to_requests",
]
