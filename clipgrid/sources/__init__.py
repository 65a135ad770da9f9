"""Readers, and the operators that turn raw listings into tables."""
