"""Operators for preparing training text: cleaning, de-duplication, mixing, packing and scoring of document tables.

Operators take and return DataFrames and name their columns by parameters.
``queries`` registers one query per operator; nothing outside this package
imports it, except the entry module behind a guard.
"""
