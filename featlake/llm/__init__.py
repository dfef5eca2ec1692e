"""Operators for preparing training corpora: tables of documents in, decisions and tokens out.

Nothing outside this subpackage imports it.
"""
