"""Operators for preparing training data; nothing else in weftline imports this package.

Its modules are imported when they are asked for: a Python worker then holds only what its operator needs.
"""


def queries() -> dict:
    from weftline.llm.registered import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from weftline.llm.registered import ORACLES

    return dict(ORACLES)
