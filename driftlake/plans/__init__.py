"""Registered queries with their DuckDB SQL, and checks of inputs."""
