"""Registered queries: a plan per name, and SQL with the same result where SQL can express it."""

from mnemoweft.plans import association, dag, evaluation, hierarchies, pipeline, retrieval, segmentation, sources, streams

MODULES = [hierarchies, association, segmentation, retrieval, dag, evaluation, sources, pipeline, streams]
