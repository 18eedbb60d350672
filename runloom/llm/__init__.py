"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it. ``queries`` holds the thin
``opN_*`` queries and ``oracles`` their DuckDB SQL.
"""
