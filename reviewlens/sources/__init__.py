"""Readers with declared schemas, and the tables as the application's inputs."""
