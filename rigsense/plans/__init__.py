"""Multi-step jobs: offline phases and model training."""
