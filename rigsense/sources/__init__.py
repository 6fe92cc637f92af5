"""Reading and writing: files, JSON payloads and the test telemetry views."""
