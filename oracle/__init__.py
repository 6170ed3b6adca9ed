"""DuckDB SQL that states each registered query a second time."""


def all_sql() -> dict[str, str]:
    from oracle import decide, ops, serve, text
    return {**text.SQL, **decide.SQL, **serve.SQL, **ops.SQL}
