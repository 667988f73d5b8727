"""Reading subtitle, recognition and session data; writing results."""
