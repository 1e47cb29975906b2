"""Readers and writers of repositories, logs and file trees."""
