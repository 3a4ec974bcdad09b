"""Readers, sinks, column conforming, quality gates and profiles."""
