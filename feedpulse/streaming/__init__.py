"""feedpulse.streaming"""
