"""Text exports."""
