"""Readers and writers: volume files, delimited exports, derived domain views."""
