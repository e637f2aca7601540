"""Readers and writers of the file formats that primer work uses."""
