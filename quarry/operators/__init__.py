"""What recorded operations do to a frame, and how measures are fused and joined."""
