"""Configuration, registry, stage cache, build DAG and command line."""
